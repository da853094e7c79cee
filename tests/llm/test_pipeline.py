"""The pipeline's stages on a small table: what each decides, beside a plain version, and the columns it returns."""

from collections import Counter, defaultdict

import pytest
from test_llm import fill, plain_groups, plain_secrets

import corpus_pipeline as pipeline
from sievestone.llm import common, language, packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_mix(before, after):
    """Sources come within a word of their targets, and each text is taken whole, twice or cut at a word's end."""
    size = lambda t: len((t or "").encode().split())
    sizes, took, times = Counter(), Counter(), defaultdict(list)
    for r in before:
        sizes[r.source] += size(r.text)
    for r in after:
        took[r.source] += size(r.text)
        times[r.doc_id].append(r)
        assert r.n_chars == len(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    assert all(abs(took[s] - want[s]) <= 1 for s in sizes)
    texts, cut = {r.doc_id: r.text for r in before}, Counter()
    for name, own in times.items():
        assert len(own) <= 2 and all(texts[name].startswith(r.text) for r in own)
        cut[own[0].source] += sum(r.text != texts[name] for r in own)
    assert max(cut.values(), default=0) <= 1


def plain_pack(before, after):
    """Every document's tokens are there once for each time it is, in sequences without gaps, as few as nearly can be."""
    t = packing.Tokenizer(packing.default_vocabulary())
    want = Counter()
    for r in before:
        want[r.doc_id] += len(t.whole.encode(r.text or "", add_special_tokens=False).ids) + 1
    got, held = Counter(), defaultdict(list)
    for r in after:
        got[r.doc_id] += r.length
        held[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in held.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 1024
    assert len(held) <= 1.02 * -(-sum(want.values()) // 1024) + 1


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = spark.createDataFrame([(9001, None, "en", "src1", 0), (9002, "12 34 !!", None, None, 8), (9003, "token=deadbeefdeadbeef the and of in", "en", "src2", 36)], docs.schema)
    docs = docs.unionByName(more)
    sizes = []
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, "")
        rows = docs.collect()
        sizes.append(len(rows))
        if name != "packing":
            assert docs.columns == COLUMNS
        if name == "language_id":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in rows} == {9001, 9002}
            model = language.identify(before, prefix="_")
            assert {r.doc_id for r in rows} == {r.doc_id for r in model.where("NOT _rejected").collect()}
        if name == "near_dedup":
            plain = plain_groups([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert sorted(r.doc_id for r in rows) == [i for i, _, root in plain if i == root]
        if name == "secret_scan":
            assert [r.text for r in rows if r.doc_id == 9003] == ["[SECRET] the and of in"]
            old = {r.doc_id: r.text for r in before.collect()}
            assert {r.doc_id for r in rows} == set(old) and not [r for r in rows if plain_secrets(r.text)]
            assert all(r.text == old[r.doc_id] for r in rows if "[SECRET]" not in r.text)
        if name == "mixing":
            plain_mix(before.collect(), rows)
        if name == "packing":
            plain_pack(before.collect(), rows)
        docs = spark.createDataFrame(rows, docs.schema)
    assert sizes[-1] > 0


def test_run(spark):
    got = pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, score string, rejected int, size int"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0), (None, "the one and only text " * 30, "en", None, 660), (None, "the one and only text " * 30, "en", None, 660), (2, "the one and only text " * 30, "en", "b", 660), (3, "word " * 50_000, "en", "b", 250_000)]])
def test_stages_on_awkward_tables(spark, rows):
    """Nulls, repeated rows, a long text, an empty table, and columns with the names of results."""
    docs = spark.createDataFrame([(*r, "mine", 7, 9) for r in rows], AWKWARD)
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in AWKWARD.split(", ")]
            assert docs.where("score <> 'mine' OR rejected <> 7 OR size <> 9").count() == 0
        docs = common.cut(docs)
        if name == "near_dedup" and rows:
            assert docs.where("doc_id = 2").count() + docs.where("doc_id IS NULL").count() == 1
    assert (docs.count() > 0) == bool(rows)


def test_run_deletes_what_it_has_read(spark):
    import glob

    before = set(glob.glob(f"{common.shared_folder(spark).removeprefix('file:')}/*"))
    pipeline.run(spark, "/root/testdata/sf0.001").count()
    left = set(glob.glob(f"{common.shared_folder(spark).removeprefix('file:')}/*")) - before
    tables = [t for f in left if "pipeline-" in f for t in glob.glob(f + "/*")]
    assert [t.rsplit("/", 1)[-1] for t in tables] == ["mixing"] and len(left) <= 4
