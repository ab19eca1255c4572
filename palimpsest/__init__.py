"""Document transcription analytics on Spark."""
