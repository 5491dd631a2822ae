"""Stages of ingestions from a stream of arrivals are those of the batch."""

import json
import random

from quillmesh.operators import contracts


def test_stream_and_batch_have_the_same_stages(spark, tmp_path):
    rng = random.Random(4)
    kinds = [*contracts.HAND_OFF_FILES, "unknown", None]
    rows = [(f"s{rng.randint(0, 30)}", rng.choice(kinds)) for _ in range(200)]
    # Repeated arrivals, and files that come in many batches in another order.
    sent = rows + rng.sample(rows, 80)
    rng.shuffle(sent)
    for k in range(7):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps({"identity": i, "kind": x}) for i, x in sent[k::7]))
    stream = spark.readStream.schema("identity string, kind string").option("maxFilesPerTrigger", 1).json(str(tmp_path))
    query = contracts.hand_off(stream, "identity").writeStream.format("memory").queryName("stages").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("stages").collect()))
    assert got == sorted(map(tuple, contracts.hand_off(spark.createDataFrame(rows, "identity string, kind string"), "identity").collect()))
    have = {i: {x for j, x in rows if j == i} & set(contracts.HAND_OFF_FILES) for i, _ in rows}
    assert {r[0]: set(r[1].split(",")) - {""} for r in got} == have and len({r[2] for r in got}) >= 4
    assert contracts.hand_off(spark.createDataFrame([], "identity string, kind string"), "identity").count() == 0
