"""sievemark: judging how far messy, self-reported records can be trusted, on Spark."""
