"""stagewatch: process-observability analytics as Spark DataFrame jobs."""
