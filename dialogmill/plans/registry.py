"""All queries by name, with the equivalent SQL."""

from dialogmill.plans import build_queries, dataset_queries, event_queries, live_queries, relational_queries, stream_queries, text_queries, web_queries  # noqa: F401  they register themselves
from dialogmill.plans.base import QUERIES, SQL  # noqa: F401

flagship = dataset_queries.qa_flagship
