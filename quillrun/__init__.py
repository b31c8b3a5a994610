"""Document extraction on Spark: pages, chunks, field models, history and export as DataFrame jobs."""
