"""quern: a Spark-native engine for code-intelligence and finding-triage tables."""
