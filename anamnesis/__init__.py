"""Memory banks on Spark: long-term conversational memory as DataFrame jobs."""
