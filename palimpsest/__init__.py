"""Change-history analytics on Spark: keyed ordered folds, rule ladders, graph closure and catalog comparison."""
