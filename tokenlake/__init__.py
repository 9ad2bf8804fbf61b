"""Spark-native corpus preparation, byte-level BPE and tokenizer analytics."""
