"""The pipeline against its parts done by hand on the smallest tables."""


import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_packing import _check
from usagelens.llm import mixing, near, pii, quality
from usagelens.llm.tables import table


def test_stages_and_rows(spark):
    docs = table(spark, SF, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]

    labels = table(spark, SF, "labels").selectExpr("doc_id", "quality AS label")
    scores = quality.scored(docs, quality.fit(docs, labels)).collect()
    good = {r["doc_id"] for r in scores if r["quality_score"] >= 0.3}
    kept = docs.where(docs["doc_id"].isin(*good))
    classes = near.classes(kept).collect()
    stay = {r["class_id"] for r in classes}
    assert stay <= good
    texts = {r["doc_id"]: r["text"] for r in pii.redacted(kept).collect() if r["doc_id"] in stay}
    rows = corpus_pipeline.run(spark, SF).collect()
    _check(rows, [{"doc_id": i, "text": t} for i, t in texts.items()], 2048)

    clean = {r["doc_id"] for r in labels.where("label = 1").collect()}
    reached = {r["doc_id"] for r in rows}
    lost = clean - good
    assert len(lost) <= 0.02 * len(clean)
    assert reached == stay


def test_stages_keep_the_columns(spark, awkward):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == [c for c in docs.columns if c != "mix_position" or name != "mixing"]
        docs = after
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_no_documents(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_sequences_follow_the_mixture(spark, make_docs, tmp_path):
    """Shares of the sources over prefixes of the sequences, from files of one source each."""
    counts = {"a": 4000, "b": 1000, "c": 250}
    ids = iter(range(sum(counts.values())))
    rows = [(next(ids), "one two three four five six seven " * 20, s) for s, n in counts.items() for _ in range(n)]
    source = {doc_id: s for doc_id, _, s in rows}
    path = str(tmp_path / "docs")
    make_docs(rows).repartition("source").write.parquet(path)
    docs = spark.read.parquet(path)
    place = {r["doc_id"]: r["mix_position"] for r in mixing.mixed(docs).collect()}
    pieces = corpus_pipeline.pack_sequences(spark, docs, SF).select("doc_id", "sequence_id", "length").collect()
    assert {r["doc_id"] for r in pieces} == set(source)
    roots = {s: n**0.5 for s, n in counts.items()}
    # Up to where the smallest source runs out; a task closes its open sequences late.
    lasts = min(n / roots[s] for s, n in counts.items()) * sum(roots.values())
    ordered = sorted(pieces, key=lambda r: r["sequence_id"])
    total = sum(r["length"] for r in ordered)
    for part in (0.25, 0.5, 0.75, 1):
        wanted, tokens = part * lasts / len(rows) * total, {s: 0 for s in counts}
        for r in ordered:
            if sum(tokens.values()) >= wanted:
                break
            tokens[source[r["doc_id"]]] += r["length"]
        for s in counts:
            share = tokens[s] / sum(tokens.values())
            assert abs(share - roots[s] / sum(roots.values())) < 0.12, (part, s, share)
    first = [place[r["doc_id"]] for r in ordered[: len(ordered) // 4]]
    assert sum(first) / len(first) < len(rows) / 4
