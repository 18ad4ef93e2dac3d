"""The chain's marginals against enumeration; held-out accuracy; spans; edges."""

import itertools

import numpy as np
import pyarrow as pa

from ibidem.llm import toxicity as X


def test_marginals():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 60):
        score, first, transition = 2 * rng.normal(size=n), rng.random(n) < 0.4, rng.normal(size=(2, 2))
        first[0] = True
        got, pairs = X._messages(score, first, transition)
        starts = [*np.flatnonzero(first).tolist(), n]
        joint = np.zeros((2, 2))
        for a, b in zip(starts, starts[1:], strict=False):
            if b - a > 12:
                break
            total, ones, both = 0.0, np.zeros(b - a), np.zeros((2, 2))
            for states in itertools.product((0, 1), repeat=b - a):
                w = np.exp(sum(score[a + i] for i in range(b - a) if states[i]) + sum(transition[i, j] for i, j in zip(states, states[1:], strict=False)))
                total += w
                ones += w * np.array(states)
                for i, j in zip(states, states[1:], strict=False):
                    both[i, j] += w
            assert np.allclose(got[a:b], ones / total)
            joint += both / total
        else:
            assert np.allclose(pairs, joint)


def test_tokens():
    names, number, doc, start, size = X.tokens(pa.array(["Éa  b,\n\tCd", None, "", " x "]))
    texts = ["Éa  b,\n\tCd", "", "", " x "]
    assert [(d, texts[d][s : s + n].lower()) for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)] == [(0, "éa"), (0, "b,"), (0, "cd"), (3, "x")]
    assert [names[i] for i in number] == ["éa", "b,", "cd", "x"]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    found = [r for r in X.op5(spark, folder).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in found)
    assert right >= 0.97 * len(found)  # some of the tables' toxic labels are on documents of symbols alone
    assert sum(r.predicted and not labels[r.doc_id] for r in found) <= 0.01 * len(found)


def test_query_covers_all(spark, tables):
    found = X.op5(spark, tables).collect()
    assert len(found) == spark.read.parquet(f"{tables}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def labelled(spark):
    """Clean texts, and ones with a bad word here and there; labels for all."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        own = [f"w{x}" for x in rng.integers(0, 4000, 60)]
        if i % 4 == 0:
            own[10] = "Badword!"
            own[30] = "badwords"
        rows.append((i, " ".join(own), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


def test_spans_and_edges(spark):
    docs, labels = labelled(spark)
    field = X.train(docs, labels)
    rows = [(1, "all is well"), (2, "so you badword here Badword! yes"), (3, None), (4, ""), (None, "badword badwords"), (5, "fine " * 40_000), (2, "so you badword here Badword! yes")]
    frame = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    found = X.tag(frame, field).collect()
    assert len(found) == len(rows)
    text = rows[1][1]
    for r in found:
        if r.doc_id == 2:
            assert [text[s.start : s.start + s.length] for s in r.spans] == ["badword", "Badword!"] and r.score >= 0.7
        elif r.doc_id is None:
            assert r.score >= 0.7
        else:
            assert r.score < 0.7 and r.spans == []
    assert X.tag(frame, None).select("score").distinct().collect()[0][0] == 0
    assert X.train(docs, labels.where("toxic = 0")) is None and X.train(docs.limit(0), labels) is None
    assert X.tag(frame.limit(0), field).count() == 0
