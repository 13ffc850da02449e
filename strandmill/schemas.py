"""Declared schemas and the score of a miss."""

MISS_SCORE = -2.0
HITS = "query_id string, hits array<struct<accession:string,score:double,vector_id:bigint>>"
RESULTS = "query_id string, results array<struct<accession:string,score:double>>"
VECTORS = "vector_id bigint, accession string, embedding array<float>"
CHUNKS = "accession string, contig_ord bigint, start int, seq string"
