"""DataFrame -> DataFrame steps. Nothing in here starts a Spark job: callers decide when to act."""
