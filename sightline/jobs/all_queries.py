"""All registered queries of the archive jobs."""

from sightline.jobs import eval_queries, search_queries, stream_queries, text_queries  # noqa: F401  (they register their queries)
from sightline.jobs.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
