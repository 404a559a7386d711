"""P-values while permutations arrive: a stream of permutation numbers, counted by feature.

Each micro-batch makes its orders in the tasks, from their numbers, and writes its partial result under the batch's number; a batch that
runs again after a failure writes the same place, and a number that came in an earlier batch counts once. Features are mapped, not
joined; nothing is kept in memory between batches, so a query that restarts from its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans import analysis
from ..plans.ranges import Partials
from ..shared import scratch_path
from ..sources.sinks import put
from ..spec import AnalysisSpec


def permutation_stream(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """perm_id, from JSON files that are put into a folder."""
    reader = spark.readStream.schema("perm_id int")
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(folder)


def counting(stream: DataFrame, features: DataFrame, spec: AnalysisSpec, folder: str) -> tuple[DataStreamWriter, Partials]:
    """The query, to be started, and where its partial results are; p_values() of these are the interim ones."""
    spark = features.sparkSession
    tasks = analysis.contrasts(spec)
    held, store = analysis.shared(spark, tasks, spec), Partials(spark, f"{folder}/partials", spec)

    def batch(numbers: DataFrame, number: int) -> None:
        name = f"batch-{number:09d}"
        asked = {r[0] for r in numbers.select("perm_id").distinct().collect() if r[0] is not None and 0 <= r[0] < len(tasks[0].orders)}
        new = sorted(asked.difference(store.permutations(but=name)))
        if new:
            store.put(name, analysis.partials_of(features, tasks, held, tuple(new)))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint"), store


def online_p(spark: SparkSession, features: DataFrame, spec: AnalysisSpec, batches: int = 2) -> DataFrame:
    """The end state after all permutations have streamed through, in a few micro-batches."""
    folder = scratch_path(spark, "stream")
    count = len(spec.orders) if spec.orders is not None else spec.permutations
    for b in range(batches):
        put(spark, f"{folder}/in/{b}.json", "".join(f'{{"perm_id": {p}}}\n' for p in range(b, count, batches)).encode())
    writer, store = counting(permutation_stream(spark, f"{folder}/in", 1), features, spec, folder)
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()
    return store.p_values().withColumn("uncp", F.round("uncp", 6))
