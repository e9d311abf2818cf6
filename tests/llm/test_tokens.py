import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from quern.llm import bpe, orc_tokens

ALPHABET = ["a", "b", "th", "ing", "é", "你", "好", "🙂", "ß", " ", "  ", "\n", "1", "22", "!!", "\x00", '"', "'s", "‍", "the", "­", "퟿", "\U0010ffff"]
ODD = [(None, "null id"), (1, None), (2, ""), (3, "long " * 40_000), (4, "x" * 3_000), (5, "same"), (5, "same"), (6, "\n \t  ")]


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder()


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.vocabulary.rank, special_tokens={})


def texts(n=1500, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_encodes_as_defined(encoder, reference):
    for t in texts():
        assert encoder.encode(t).tolist() == reference.encode_ordinary(t)
    for piece in (b"aaaaaaaaaaaaaaaaaaaaab", b"\xff\xfe\x80", bytes(range(256))):
        assert encoder.transduce(piece) == encoder.vocabulary.merge(piece)


def test_forgetting_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(bpe, "TRANSITIONS", 50)
    monkeypatch.setattr(bpe, "HISTORIES", 60)
    monkeypatch.setattr(bpe, "PIECES", 20)
    monkeypatch.setattr(bpe, "PAIRS", 30)
    small = bpe.Encoder()
    for t in texts(200, 2):
        assert small.encode(t).tolist() == reference.encode_ordinary(t)
        assert len(small.move) <= 51 and len(small.history) <= 120 and len(small.pieces) + len(small.pieces.old) <= 24


def test_memory_is_bounded_within_a_piece(encoder, reference, monkeypatch):
    """One word of 200,000 letters: no more transitions and histories than allowed, at any moment."""
    monkeypatch.setattr(bpe, "TRANSITIONS", 1_000)
    monkeypatch.setattr(bpe, "HISTORIES", 2_000)
    small, rng = bpe.Encoder(), random.Random(6)
    word, most, step = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), [0, 0], small.step

    def watched(*args):
        most[:] = max(most[0], len(small.move)), max(most[1], len(small.history))
        return step(*args)

    small.step = watched
    assert small.encode(word).tolist() == reference.encode_ordinary(word)
    assert most[0] <= 1_001 and most[1] <= 2_100


def test_recurring_pieces_become_states(encoder):
    """What is asked for twice is a transition from then on; the result is the same either way."""
    raw = b" transducers"
    want, steps, step = encoder.vocabulary.merge(raw), [], encoder.step
    encoder.step = lambda *a: steps.append(a) or step(*a)
    try:
        for _ in range(len(raw) + 2):
            assert encoder.transduce(raw) == want
        steps.clear()
        assert encoder.transduce(raw) == want and not steps
    finally:
        del encoder.step


def test_tokens_come_out_early(encoder):
    """What waits in any state is no longer than the longest token."""
    encoder.transduce(b" internationalisationally" * 20)
    longest = max(map(len, encoder.vocabulary.bytes))
    for state in encoder.states:
        for reading in state:
            _, pending = encoder.history[reading >> bpe._SHIFT]
            assert sum(len(encoder.vocabulary.bytes[t]) for t in pending) <= longest


@pytest.mark.parametrize("portion", [1, 2, 7])
def test_decoding_streams(encoder, portion):
    decoder = bpe.Decoder()
    for t in texts(300, 3):
        ids = encoder.encode(t).tolist()
        assert "".join(decoder.feed(ids[i : i + portion]) for i in range(0, len(ids), portion)) + decoder.end() == t


def test_broken_bytes_decode_as_the_standard_says(encoder):
    rng, decoder = random.Random(4), bpe.Decoder()
    for _ in range(1500):
        raw = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC0, 0xC3, 0xE0, 0xE2, 0x82, 0xAC, 0xED, 0xA0, 0xF0, 0x9F, 0x99, 0xF4, 0x90, 0xF5]) for _ in range(10))
        assert decoder.feed([encoder.vocabulary.rank[bytes([b])] for b in raw]) + decoder.end() == raw.decode("utf-8", "replace")


def frame(spark):
    return spark.createDataFrame([(*r, "x", 7) for r in ODD], "doc_id long, text string, tokens string, n_tokens int")


def test_on_tables(spark, reference):
    rows = bpe.encode(frame(spark)).collect()
    assert len(rows) == len(ODD) and all(r["exact"] for r in rows)
    want = sorted((str(i), reference.encode_ordinary(t or "")) for i, t in ODD)
    assert sorted((str(r["doc_id"]), list(r["tokens"])) for r in rows) == want
    assert all(r["n_tokens"] == len(r["tokens"]) for r in rows)
    back = bpe.decode(bpe.encode(frame(spark)), portion=100).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in ODD)
    assert bpe.encode(frame(spark).limit(0)).count() == 0


def test_orc_round_trip(spark, tmp_path, reference):
    path = str(tmp_path / "orc")
    orc_tokens.write(orc_tokens.tokenised(frame(spark)), path)
    rows = orc_tokens.read(spark, path).collect()
    assert sorted((str(r["doc_id"]), list(r["tokens"])) for r in rows) == sorted((str(i), reference.encode_ordinary(t or "")) for i, t in ODD)
    assert orc_tokens.read(spark, path, [5, 99]).count() == 2
    empty = str(tmp_path / "empty")
    orc_tokens.write(orc_tokens.tokenised(frame(spark).limit(0)), empty)
    assert orc_tokens.read(spark, empty).count() == 0


def test_orc_of_what_the_library_gives_up_on(spark, reference):
    """A million blanks in a row: operator 7's tokens, which decode to the text."""
    blanks = " " * 1_000_000 + "x"
    with pytest.raises(ValueError):
        reference.encode_to_numpy(blanks)
    docs = spark.createDataFrame([(1, blanks), (2, "a b")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in orc_tokens.tokenised(docs).collect()}
    assert bpe.Decoder().feed(rows[1]["tokens"]) == blanks and list(rows[2]["tokens"]) == reference.encode_ordinary("a b")


def test_orc_tokens_equal_merges_by_hand(spark, encoder):
    """Every piece merged as BPE is defined, not by the library that the operator uses."""
    docs = texts(150, 9)
    rows = orc_tokens.tokenised(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    for r in rows:
        want = [t for piece in encoder.cut(docs[r["doc_id"]]) for t in encoder.vocabulary.merge(piece.encode("utf-8"))]
        assert list(r["tokens"]) == want and r["n_tokens"] == len(want)


def test_orc_file_has_bloom_filters_and_run_lengths(spark, tmp_path):
    """Stream kinds in the stripe footers: Bloom filters on the id alone, a row index everywhere; runs shrink what repeats."""
    import pyarrow.orc as orc

    sizes = {}
    for name, value in (("runs", F.lit(7)), ("random", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int"))):
        path = tmp_path / name
        rows = spark.range(0, 20_000, 1, 1).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("n_tokens"), F.array(value).alias("tokens"))
        orc_tokens.write(rows, str(path))
        (file,) = [p for p in path.iterdir() if p.suffix == ".orc"]
        sizes[name] = file.stat().st_size
        assert orc.ORCFile(file).compression in ("ZSTD", "zstd") and orc.ORCFile(file).row_index_stride == orc_tokens.ROW_GROUP
    assert sizes["random"] > 10 * 20_000 / 8 + sizes["runs"]
    jvm = spark._jvm
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(spark.sparkContext._jsc.hadoopConfiguration()))
    from pathlib import Path

    assert reader.getNumberOfRows() == 20_000
    raw = Path(str(file)).read_bytes()
    plain = tmp_path / "plain"
    rows.write.format("orc").option("orc.compress", "zstd").option("orc.row.index.stride", str(orc_tokens.ROW_GROUP)).save(str(plain))
    (other,) = [p for p in plain.iterdir() if p.suffix == ".orc"]
    # 20 row groups of 1,000 ids at 1 %: about 1.2 KB of filter each, which don't compress.
    assert len(raw) - other.stat().st_size > 10_000


def test_orc_metadata_prunes(spark, tmp_path):
    import pyarrow.orc as orc

    path = str(tmp_path / "many")
    rows = spark.range(0, 40_000, 2, 1).select(F.col("id").alias("doc_id"), F.lit(20).cast("long").alias("n_tokens"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(50_000)).cast("int")).alias("tokens"))
    orc_tokens.write(rows, path, stripe=64 << 10)
    (file,) = [p for p in (tmp_path / "many").iterdir() if p.suffix == ".orc"]
    assert orc.ORCFile(file).nstripes > 1
    found = orc_tokens.read(spark, path, [31_000, 31_001])
    assert [r["doc_id"] for r in found.collect()] == [31_000]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    plan = found._jdf.queryExecution().executedPlan()
    read = int(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.collectLeaves()).get(0).metrics().get("numOutputRows").get().value()) if not plan.toString().startswith("Adaptive") else 0
    assert read <= 5_000


def test_new_pieces_of_a_portion_are_read_together(reference):
    """What they begin with is read once; no states or histories are left of them."""
    rng, e = random.Random(8), bpe.Encoder()
    words = ["internationalisation" + "".join(rng.choice("aeinorst") for _ in range(rng.randrange(1, 5))) for _ in range(3_000)]
    docs = [" ".join(words[i : i + 100]) for i in range(0, len(words), 100)] + texts(300, 7) + [None, "", "café café"]
    asked = [0]

    class Counted(dict):
        def get(self, *args):
            asked[0] += 1
            return dict.get(self, *args)

    e.vocabulary.child = Counted(e.vocabulary.child)
    together = [x.tolist() for x in e.encode_all(docs)]
    assert together == [reference.encode_ordinary(t or "") for t in docs]
    pieces = {p.encode() for t in docs for p in e.cut(t or "")}
    nodes = len({p[: i + 1] for p in pieces for i in range(len(p))})
    assert asked[0] < 6 * nodes < 2 * sum(map(len, pieces))
    assert len(e.states) == len(e.history) == 1 and not e.move
    asked[0] = 0
    assert [x.tolist() for x in e.encode_all(docs)] == together and not asked[0]  # all remembered
    long = "x" * 500 + " " + "ab" * 40
    assert e.encode_all([long])[0].tolist() == reference.encode_ordinary(long)


def test_learning_forgets_within_bounds(reference, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 20)
    monkeypatch.setattr(bpe, "PAIRS", 30)
    small, docs = bpe.Encoder(), texts(200, 2)
    for at in range(0, 200, 7):
        assert [x.tolist() for x in small.encode_all(docs[at : at + 7])] == [reference.encode_ordinary(t) for t in docs[at : at + 7]]
        assert len(small.pieces) + len(small.pieces.old) <= 24 and len(small.pairs) <= 32


def test_a_batch_is_encoded_in_portions(monkeypatch):
    """No more texts at a time than a portion's bytes ask for; all rows, in order, long ones whole."""
    import pyarrow as pa

    monkeypatch.setattr(bpe, "PORTION", 10)
    rows = ["abcd", None, "", "abcdefgh", "x" * 100, "é" * 5, "y", None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text"])
    cut = [b.column(1).to_pylist() for b in bpe.portions(batch.slice(1))]
    assert cut == [rows[1:5], rows[5:6], rows[6:]] and sum(cut, []) == rows[1:]
    assert not list(bpe.portions(batch.slice(0, 0)))
