"""reviewtrust: Spark operators for judging how far product reviews can be trusted."""
