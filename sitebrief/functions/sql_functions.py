"""The extractors for SQL users: functions from a text to an array of entities.

    SELECT d.doc_id, e.* FROM documents d LATERAL VIEW inline(emails_in(d.text)) e

Each returns what its extractor returns: type, value, normalized, confidence, context, extra.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from sitebrief.functions import extract as E

FUNCTIONS = {
    "emails_in": (E.scan_emails,), "phones_in": (E.scan_phones,), "addresses_in": (E.scan_addresses,),
    "handles_in": (E.scan_handles,), "technologies_in": (E.scan_tech,),
    "entities_in": (E.scan_emails, E.scan_phones, E.scan_addresses, E.scan_handles),
}


def register(spark: SparkSession) -> None:
    for name, scans in FUNCTIONS.items():
        spark.udf.register(name, E.column(*scans))
