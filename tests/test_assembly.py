"""Documents and detections that arrive in parts and in any order give the rows of the batch query."""

import datetime as dt
import json
import random

import pytest

from quillmask.operators import evaluate
from quillmask.sources import detections
from quillmask.streaming import assembly

START = dt.datetime(2026, 1, 1)


def rows_of(evaluated):
    return sorted((r.doc_id, [(x.bucket, x.status, len(x.hits), tuple(x.notes)) for x in r.results], sorted(map(tuple, r.duplicates))) for r in evaluated.select("doc_id", "results", "duplicates").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival(spark, tmp_path, seed):
    rng = random.Random(seed)
    names = ["Ann", "Bob", "Ann Lee", "lee", "", "+1 555 123 456"]
    docs, dets = [], {}
    for i in range(30):
        docs.append((i, None if i == 3 else " ".join(rng.choice(["Ann", "Bob", "Lee", "x", "(555) 1"]) for _ in range(rng.randrange(0, 9)))))
        dets[i] = [[{"type": "N", "value": rng.choice(names)} for _ in range(rng.randrange(0, 4))] for _ in range(rng.randrange(1, 4))]
    batch = spark.createDataFrame([(i, t, [d for part in dets[i] for d in part]) for i, t in docs], f"doc_id long, text string, dets {detections.DETECTIONS}")
    want = rows_of(evaluate.evaluate(batch, suggest=False))

    at = lambda: START + dt.timedelta(seconds=rng.randrange(600))
    arriving = [("d", (i, t, at())) for i, t in docs]
    arriving += [("p", (i, n, len(own), json.dumps({"pii": part}), at())) for i, own in dets.items() for n, part in enumerate(own)]
    arriving += rng.choices(arriving, k=20)  # some come twice
    arriving += [("p", (99, 0, 1, '{"pii":[]}', at())), ("d", (None, "x", at())), ("p", (50, 0, 2, '{"pii":[{"type":"N","value":"Ann"}]}', at())), ("d", (50, "Ann", at()))]  # no document; no identifier; a part that never comes
    rng.shuffle(arriving)
    folders = {"d": str(tmp_path / "docs"), "p": str(tmp_path / "parts")}
    schemas = {"d": assembly.DOCUMENTS, "p": assembly.PARTS}
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    # all that was left waiting ends when the time has moved on
    ends = [[("d", (1000, "", START + dt.timedelta(days=n))), ("p", (1000, 0, 1, "{}", START + dt.timedelta(days=n)))] for n in (1, 2)]
    for events in [arriving[:50], arriving[50:], *ends]:
        for kind, folder in folders.items():
            own = [row for k, row in events if k == kind]
            spark.createDataFrame(own, schemas[kind]).coalesce(1).write.mode("append").parquet(folder)
        whole = assembly.assemble(*assembly.read_parts(spark, folders["d"], folders["p"]))
        query = assembly.evaluate_stream(whole, out, state)
        assert query.awaitTermination(240)
    got = rows_of(spark.read.parquet(out).where("doc_id < 50"))
    assert got == want
    late = spark.read.parquet(out).where("doc_id >= 50 and doc_id < 1000").collect()
    assert [(r.doc_id, [x.bucket for x in r.results]) for r in late] == [(50, ["matched"])]
