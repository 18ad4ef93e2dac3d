"""The pipeline's stages: columns, decisions that take effect, and what planted documents come to."""

import zlib

import corpus_pipeline as C
from ibidem.llm import decontaminate, quality, simhash, toxicity
from ibidem.llm.common import materialize


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_dedup", "decontamination", "packing"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    judged = {
        "toxicity": lambda d: {r.doc_id for r in toxicity.scored(d, spark.read.parquet(f"{folder}/labels.parquet")).where(f"score < {toxicity.THRESHOLD}").collect()},
        "quality": lambda d: {r.row.doc_id for r in quality.annotate(d).where("kept").collect()},
        "near_dedup": lambda d: {r.component_id for r in simhash.near_duplicates(d).collect()},
        "decontamination": lambda d: set(ids(d)) - {r.doc_id for r in decontaminate.overlaps(d, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()},
    }
    now = docs
    for name, stage in C.STAGES[:-1]:
        out = materialize(stage(spark, now, folder), "test")
        assert out.columns == docs.columns and set(ids(out)) == judged[name](now) < set(ids(now))
        if name == "toxicity":
            clean = [k for k in ids(now) if k in labels and not labels[k].toxic]
            assert set(clean) <= set(ids(out))
        now = out
    packed = C.STAGES[-1][1](spark, now, folder)
    assert set(ids(packed)) == set(ids(now))


def test_stages_by_brute_force(spark, tables):
    """Each stage on the rows that the one before it kept, against plain Python that shares no code with it."""
    import test_decontaminate
    import test_packing
    import test_quality
    import test_simhash

    def rows(frame):
        return {r.doc_id: r for r in frame.collect()}

    stages, docs = dict(C.STAGES), spark.read.parquet(f"{tables}/documents.parquet")
    labels = rows(spark.read.parquet(f"{tables}/labels.parquet"))
    items = {r.item_id: r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    now = materialize(stages["toxicity"](spark, docs, tables), "test")
    gone = rows(docs).keys() - rows(now).keys()
    known = [k for k in gone if k in labels]
    assert all(labels[k].toxic for k in known)

    before = rows(now)
    now = materialize(stages["quality"](spark, now, tables), "test")
    after = rows(now)
    counts = {k: test_quality.base(r.text) for k, r in before.items()}
    failed = {k for k, (n, _, _, _, repeats) in counts.items() if n < 50 or 100 * repeats > 50 * n}
    assert not failed & after.keys()
    usable = [k for k in before if counts[k][0] >= 50]
    groups = {}
    for k in usable:
        groups.setdefault((before[k].lang, before[k].source), []).append(k)
    small = {}
    for (lang, _), ks in groups.items():  # no group has rows enough of its own here
        assert len(ks) < quality.LEAST_ROWS
        small.setdefault(lang, []).extend(ks)
    pooled = {}
    for lang, ks in small.items():
        pooled.setdefault(lang if len(ks) >= quality.LEAST_ROWS else "all", []).extend(ks)
    for ks in pooled.values():
        _, distance = test_quality.least_determinant([test_quality.vector(before[k].text) for k in ks])
        for k, d in zip(ks, distance):
            if k not in failed and abs(d - quality.CUTOFF) > 0.1 * d + 0.1:
                assert (k in after) == (d <= quality.CUTOFF)

    before = after
    now = materialize(stages["near_dedup"](spark, now, tables), "test")
    ids_, tops = list(before), test_simhash.groups([test_simhash.fingerprint(r.text) for r in before.values()], 2)
    least = {}
    for k, top in zip(ids_, tops):
        least[top] = min(least.get(top, k), k)
    after = rows(now)
    assert after.keys() == set(least.values())

    before = after
    now = materialize(stages["decontamination"](spark, now, tables), "test")
    after = rows(now)
    for k, r in before.items():
        text = test_decontaminate.words(r.text)
        stretch = max(test_decontaminate.best(text, test_decontaminate.words(t)) for t in items.values())
        assert stretch < 16 or k not in after
        assert stretch >= 8 or k in after

    encoder = test_packing.Encoder(test_packing.PATH)
    packed = stages["packing"](spark, now, tables).collect()
    sizes, places = {}, {}
    for r in packed:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sizes.keys() == after.keys()
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) >= sum(sizes.values()) / 1024
    for k, r in after.items():
        assert sizes[k] == len(test_packing.plain(encoder, r.text)) // 4 + 1


def test_run_and_clashing_columns(spark, tmp_path):
    folder = str(tmp_path)
    words = lambda i, n: " ".join(f"w{zlib.crc32(f'{i}.{j}'.encode()) % 9973}" for j in range(n))
    rows = [(i, words(i, 120), "en", "s", 0, "x") for i in range(90)]
    rows += [(200, rows[0][1], "en", "s", 0, "x"), (300, None, None, None, None, None), (None, words(1000, 90), "en", "s", 0, "x"), (301, "", "en", "s", 0, "x")]
    item = words(7777, 40)
    rows.append((400, f"{words(400, 60)} {item} {words(401, 60)}", "en", "s", 0, "x"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    found = C.run(spark, folder)
    left = {r.doc_id for r in found.collect()}
    assert left == {*range(90), None}
