"""Named queries over the tables of a data directory, each with the SQL that says the same."""

from vcspark.plans import catalogue, coercions, detections, discovery, ingestion, media, pictures, replacement, reports, texts, titles, video
from vcspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalogue", "coercions", "detections", "discovery", "ingestion", "media", "pictures", "replacement", "reports", "texts", "titles", "video"]
