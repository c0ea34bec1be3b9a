"""lumispan: traces of language-model agents on Spark.

``SpanStore`` keeps spans as Parquet with last-write-wins upserts, deletes and retention; the
functions in ``lumispan.operators`` answer queries over any DataFrame of spans.
"""
