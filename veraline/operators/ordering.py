"""Positions and running totals over a global order, without a single-task window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraline.plans.store import materialize


def running_totals(df: DataFrame, order: list[str | Column], weights: dict[str, str], label: str = "ordered", position: str = "position") -> DataFrame:
    """df in the given order with `position` (from 0) and, for each name -> column of
    weights, the total of that column (null counts 0) over all rows before.

    Range partitions are sorted and summed on their own; only one total per
    partition meets on the driver, so no task or window sees all rows.  The
    result is a table in the shared folder.  Ties in the order are broken by
    nothing but their row: order by enough columns.
    """
    names = list(weights)
    clash = {c.lower() for c in df.columns} & {position.lower(), *(n.lower() for n in names), "vl_part", "vl_pos", "vl_n", *(f"vl_{k}{i}" for k in ("sum_", "w") for i in range(len(names)))}
    if clash:
        raise ValueError(f"rows already have {', '.join(sorted(clash))}: name the results otherwise")
    fields = [*df.schema.fields, T.StructField("vl_part", T.IntegerType()), T.StructField("vl_pos", T.LongType()), *(T.StructField(f"vl_sum_{i}", T.LongType()) for i in range(len(names)))]
    columns = list(weights.values())
    wanted = df.columns

    def local(batches):
        part, done, sums = TaskContext.get().partitionId(), 0, [0] * len(columns)
        for batch in batches:
            n = batch.num_rows
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in wanted]
            arrays += [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n, dtype=np.int64))]
            for i, c in enumerate(columns):
                w = np.asarray(batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
                ends = np.cumsum(w) + sums[i]
                arrays.append(pa.array(ends - w))
                sums[i] = int(ends[-1]) if n else sums[i]
            done += n
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    table = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(local, T.StructType(fields)), label)
    totals = table.groupBy("vl_part").agg(F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"w{i}") for i, c in enumerate(columns))).orderBy("vl_part").collect()
    rows, run = [], [0] * (1 + len(columns))
    for t in totals:
        rows.append((t["vl_part"], *run))
        run = [a + b for a, b in zip(run, list(t)[1:], strict=True)]
    schema = "vl_part int, vl_n long" + "".join(f", vl_w{i} long" for i in range(len(columns)))
    base = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # one row per partition
    out = table.join(base, "vl_part").select(*wanted, (F.col("vl_n") + F.col("vl_pos")).alias(position), *(((F.col(f"vl_w{i}") + F.col(f"vl_sum_{i}")).alias(name)) for i, name in enumerate(names)))
    out._veraline_path = table._veraline_path
    return out


def keyed_totals(df: DataFrame, key: str, order: list[str | Column], weights: dict[str, str], label: str = "keyed") -> DataFrame:
    """running_totals() within each key: positions and totals count from the key's first row.

    A key with a third of all rows is spread over range partitions like the others; what
    is taken off is one row of totals a key.
    """
    placed = running_totals(df, [key, *order], weights, label)
    first = placed.groupBy(key).agg(F.min("position").alias("vl_p"), *(F.min_by(n, "position").alias(f"vl_f{i}") for i, n in enumerate(weights)))
    starts = materialize(first.withColumnRenamed(key, "vl_key"), f"{label}-starts")
    out = placed.join(starts, placed[key].eqNullSafe(starts["vl_key"]))
    return out.select(*df.columns, (F.col("position") - F.col("vl_p")).alias("position"), *((F.col(n) - F.col(f"vl_f{i}")).alias(n) for i, n in enumerate(weights)))
