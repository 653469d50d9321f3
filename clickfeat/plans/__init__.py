"""End-to-end plans: the feature table, training sets, test set, registered queries."""
