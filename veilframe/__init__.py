"""veilframe: prompt-privacy and LLM-usage analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
