"""Document pipelines as Spark jobs: attribute queries, stage rules, enrichment and catalogs."""
