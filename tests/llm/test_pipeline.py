"""The pipeline's stages, each against a plain version on its own input."""

import itertools
import re
import sys
from pathlib import Path

import pytest

from terrascape.llm import pipeline as corpus_pipeline
from terrascape.llm import queries, toxicity
from terrascape.llm.labels import labelled_sample

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_ops import decontaminate_plain  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_act_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.where("doc_id < 5").unionByName(docs.where("doc_id < 3")).selectExpr("CASE WHEN doc_id = 4 THEN NULL ELSE doc_id END AS doc_id", "text", "lang", "source", "n_chars")
    docs = docs.where("doc_id >= 5").unionByName(again)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        after = docs.collect()
        assert 0 < len(after) <= len(before)
        if name == "exact_dedup":
            least = {}
            for r in before:
                if r.text not in least or r.doc_id is not None and (least[r.text] is None or r.doc_id < least[r.text]):
                    least[r.text] = r.doc_id
            assert sorted((str(r.doc_id), r.text) for r in after) == sorted((str(d), t) for t, d in least.items())
        if name == "near_dedup":
            sets = {r.text: {tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(max(1, len(w) - 4))} for r in after}
            for a, b in itertools.combinations(sets.values(), 2):
                assert len(a & b) < 0.8 * len(a | b)
            assert len(after) < len(before)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert all(0 < r.taken <= 3 * r.size for r in mixed)


def key(r):
    return str(tuple(r))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_plain(rows):
    """Of each component of rows linked at 0.8, the one with the least id, or all rows of a component without ids; empty sets are linked with nothing."""
    sets, root = [shingles(r.text) for r in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    out = []
    for of in groups.values():
        ids = [r.doc_id for r in of if r.doc_id is not None]
        stay = [r for r in of if r.doc_id == min(ids)] if ids else of
        out += list({key(r): r for r in stay}.values()) if len(of) > 1 else stay
    return out


HARD = [(None, "a short one without an id", "en", "x", 1), (9001, None, "en", "x", 0), (9002, "", None, None, 0), (9003, "  \t\n ", "en", "x", 0), (9004, "word " * 60_000, "en", "y", 1), (9005, "y" * 200_000, "en", "y", 1),
        (9006, "Ties are ties in this text of some more words than five", "en", "x", 1), (9006, "Ties are ties in this text of some more words than five", "en", "x", 1), (9007, "ties are ties in this text of some more words than five", "en", "x", 1)]


def test_stages_against_plain_versions(spark):
    """Every stage on a table with nulls, empty and very long texts, ties and repeated rows, and columns with clashing names."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 70").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.createDataFrame(HARD, columns)).selectExpr("*", "1 AS _mark", "'k' AS _KEY", "2 AS digest", "3 AS chunk", "0 AS held", "'z' AS kept")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(*map(list, zip(*labelled_sample(docs, labels, "toxic", (3, 1), 3000, 32_768), strict=True)))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {
        "toxicity": lambda rows: [r for r, p in zip(rows, model.scores([r.text or "" for r in rows]), strict=True) if p < 0.7],
        "near_dedup": near_plain,
        "decontamination": lambda rows: [r for r in rows if not any(decontaminate_plain(t, r.text or "", 0.08) for t in items if len(t) < 300 and len(r.text or "") < 1500)],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        after = got.collect()
        if name in ("toxicity", "near_dedup"):
            assert sorted(map(key, after)) == sorted(map(key, plain[name](before)))
        if name == "decontamination":  # the plain version is slow, so it judges short texts; what it drops is dropped
            stay = set(map(key, plain[name](before)))
            assert {key(r) for r in after} <= stay and len(after) < len(before)
        docs = spark.createDataFrame(after, docs.schema)
    left = {r.doc_id for r in docs.collect()}
    assert {9001, 9003, 9004, 9005, 9006} & left >= {9004, 9005, 9006} and 9007 not in left
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    by = {}
    for r in mixed:
        by.setdefault(r.source, []).append(r)
    assert all(abs(sum(r.taken for r in of) - of[0].target) <= 1 for of in by.values() if of[0].target >= 1) and all(0 < r.taken <= 3 * r.size for r in mixed)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_on_an_empty_table(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert stage(spark, docs, SF).count() == 0


def test_registered(spark):
    import corpus_pipeline as root

    assert root.STAGES is corpus_pipeline.STAGES and root.run is corpus_pipeline.run and root.ORACLE_SQL is None
    found = queries.queries()
    assert "pipeline" in found and sorted(int(k[2:].split("_")[0]) for k in found if k != "pipeline") == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(found)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
