"""The pipeline's stages: each on its own input, and all in turn."""

import zlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
from pyspark.sql import functions as F
from test_operators import classes, docs, ids, lib, none, odd, slow_base, slow_contamination, slow_fingerprint  # noqa: F401

from lexiscape.llm import decontaminate, langid, pii, queries, simhash


def slow_masked(text):
    out, at = [], 0
    for s, e, kind in slow_base(text):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


def slow_packed(lengths, size=4096):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= n]
        if fit:
            gaps[min(fit, key=lambda i: gaps[i])] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


def test_run_equals_brute_force(spark, small, docs, odd, lib, tmp_path):  # noqa: F811
    """All stages in turn over whole documents, odd rows (nulls, empty, very long, repeated, clashing columns) among them."""
    table = docs.unionByName(odd, allowMissingColumns=True)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [tuple(r) for r in table.select("doc_id", "text").collect()]
    rows = [(i, x) for i, x in rows if x and any(c.isalpha() for c in x)]
    lab = classes([slow_fingerprint(x) for _, x in rows])
    first = {}
    for (i, x), c in zip(rows, lab):
        row = (i is None, i or 0, x)
        first[c] = min(first.get(c, row), row, key=lambda r: r[:2])
    rows = [(None if gone else i, x) for gone, i, x in first.values()]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    clean = [(i, x) for i, x in rows if not next(iter(slow_contamination([(i, x)], items)))[-1]]
    assert 0 < len(clean) < len(rows)
    want, added = Counter(), 0
    for i, x in clean:
        plain, every = pii.spans(x)
        added += plain != every
        own = [*ids(lib, slow_masked(x) if plain == every else pii.masked(x)), 1]
        for p, s in enumerate(range(0, len(own), 4096)):
            want[i, p, s, len(own[s : s + 4096]), zlib.crc32(np.array(own[s : s + 4096], "<u4").tobytes())] += 1
    assert added < 0.1 * len(clean)
    got = P.run(spark, str(tmp_path)).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == slow_packed([r["length"] for r in got])


def test_empty_tables(spark, small, none, tmp_path):  # noqa: F811
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    a = P.language(spark, docs, small).cache()
    assert a.columns == list(P.COLUMNS)
    known = {r["doc_id"] for r in langid.identify(docs).where("lang_pred <> 'und'").collect()}
    assert {r["doc_id"] for r in a.collect()} == known
    b = P.near_dedup(spark, a, small).cache()
    names = {r["component_id"] for r in simhash.near_duplicates(a).collect()}
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(names)
    c = P.decontamination(spark, b, small).cache()
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    bad = {r["doc_id"] for r in decontaminate.contamination(b, bench).where("contaminated").collect()}
    assert {r["doc_id"] for r in c.collect()} == names - bad and bad
    d = P.personal_data(spark, c, small)
    assert pii.detect(d).where("spans <> ''").count() == 0 and d.count() == c.count()
    assert d.columns == docs.columns
    out = P.run(spark, small)
    assert {r["doc_id"] for r in out.collect()} == names - bad


def test_registered(spark, small):
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline"} | set(queries.queries()) <= names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_lost_text(spark, small):
    """Rows with nulls pass the filtering stages or go by their rule."""
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "The cat sat on the mat and then it went out for a walk", "en", None, None), (3, "The dog ran over the hill and then it came back for the bone", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, small)
    assert {r["doc_id"] for r in docs.select(F.col("doc_id")).collect()} <= {2, 3}
