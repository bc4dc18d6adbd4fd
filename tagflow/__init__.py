"""tagflow: tag-data analytics expressed as Spark DataFrame plans.

Sub-packages:
  sources    -- table readers, adapters from the test tables, sinks
  functions  -- column expressions (parsing, scores, classification)
  operators  -- DataFrame -> DataFrame operators (filters, counts, graph, clusters, hierarchy)
  plans      -- end-to-end jobs (genre pipeline, sampling, hierarchy run, reports)
  streaming  -- Structured Streaming ingest and maintained counts
"""

__version__ = "0.1.0"
