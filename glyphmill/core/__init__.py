"""The tokenizer engine itself: compiled once on the driver, applied on the executors."""
