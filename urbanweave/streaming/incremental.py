"""Month loading as a stream over the landing folder.

Each run takes the files that arrived since the last one and stops. An arrival
is treated as the batch jobs treat a feed: first copies first, then the rules,
then the features. Copies across arrivals are kept out by the id check of the
load; a later copy of a trip whose first copy broke a rule in an earlier arrival
is not known to be one, and is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from urbanweave.operators.cleaning import keep_valid
from urbanweave.plans.jobs import add_all_features, first_copies, typed_trips
from urbanweave.schemas import RAW_TRIP
from urbanweave.sources.tables import TRIPS_TABLE, append_trips


def landed_stream(spark: SparkSession, folder: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(RAW_TRIP).format(fmt).load(folder)


def arrival_features(arrival: DataFrame) -> DataFrame:
    """Feature trips of one arrival of landed rows, as the batch jobs make them."""
    return add_all_features(keep_valid(first_copies(typed_trips(arrival))))


def load_arrivals(
    spark: SparkSession, folder: str, progress: str, table: str = TRIPS_TABLE, fmt: str = "json"
) -> StreamingQuery:
    """Load everything that arrived since the last run into ``table``.

    A batch that is repeated after a failure adds nothing, since its ids are
    found in the table.
    """

    def append(batch: DataFrame, _: int) -> None:
        append_trips(arrival_features(batch), table)

    return (
        landed_stream(spark, folder, fmt)
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
