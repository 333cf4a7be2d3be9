"""turnloom: Spark-native analytics for streaming, speaker-attributed conversation data."""
