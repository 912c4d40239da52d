"""Distances of objects that arrive in a stream, as an extension: each micro-batch is measured against all before it and
within itself, so no pair is measured twice and none is left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.functions.codecs import PairMeter, codec, compressed_size
from affinis.operators.distance import ncd


def new_pairs(known: DataFrame, fresh: DataFrame, settings) -> DataFrame:
    """i, j, ncd (by object_id, i before j) of the pairs with a fresh object. fresh is a micro-batch and is sent to each task."""
    settings = codec(settings)
    batch = sorted((r["object_id"], bytes(r["payload"])) for r in fresh.select("object_id", "payload").toLocalIterator())
    held = fresh.sparkSession.sparkContext.broadcast(batch)

    def measure(batches):
        own = held.value
        c = {i: compressed_size([x], settings) for i, x in own}
        for b in batches:
            out = []
            for i, x in zip(b.column("object_id").to_pylist(), b.column("payload").to_pylist(), strict=True):
                is_new = i in c
                cx = c[i] if is_new else compressed_size([x], settings)
                for j, y in own:
                    if is_new and j <= i:
                        continue
                    (p, px, cp), (q, py, cq) = sorted([(i, x, cx), (j, y, c[j])])
                    out.append((p, q, cp, cq, PairMeter(settings).size(px, py)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.string()) for k in cols[:2]), *(pa.array(k, pa.int64()) for k in cols[2:])], ["i", "j", "cx", "cy", "cxy"])

    every = known.select("object_id", "payload").unionByName(fresh.select("object_id", "payload"))
    pairs = every.mapInArrow(measure, "i string, j string, cx long, cy long, cxy long")
    return pairs.select("i", "j", ncd(F.col("cx"), F.col("cy"), F.col("cxy")).alias("ncd"))


def watch(stream: DataFrame, objects_path: str, pairs_path: str, settings, checkpoint: str):
    """Starts a query that appends arriving objects (object_id, payload) and their distances; a replayed batch is written over."""
    schema = "object_id string, payload binary"

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("object_id", "payload").dropDuplicates(["object_id"]).persist()
        try:
            known = spark.read.schema(f"{schema}, batch long").option("recursiveFileLookup", "false").parquet(objects_path).where(F.col("batch") < number).select("object_id", "payload")
        except Exception as e:  # the first batch has nothing before it
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], schema)
        fresh = fresh.join(known.select("object_id"), "object_id", "left_anti").persist()
        new_pairs(known, fresh, settings).write.mode("overwrite").parquet(f"{pairs_path}/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{objects_path}/batch={number}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
