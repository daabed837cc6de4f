"""Dumps to a store of memories, and the list to choose from."""

from pyspark.sql import DataFrame

from persona_spark.operators.pages import display_label, display_title, object_split, pages_to_memories
from persona_spark.operators.ranking import display_order
from persona_spark.operators.store import latest_per_id
from persona_spark.sources.dumps import page_responses


def ingest_memories(responses: DataFrame) -> DataFrame:
    """Memories of all complete dumps, the newest state of each."""
    pages, _ = object_split(page_responses(responses))
    return latest_per_id(pages_to_memories(pages))


def browse_list(pages: DataFrame) -> DataFrame:
    """(persona_id, id, label, display_rank): what a person sees when choosing memories."""
    labels = display_label(display_title(pages)).select("persona_id", "id", "ingest_pos", "label")
    ranks = display_order(pages)
    return labels.join(ranks, ["persona_id", "id", "ingest_pos"]).select("persona_id", "id", "label", "display_rank")
