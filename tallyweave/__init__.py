"""tallyweave: record-integrity, reconciliation and training-data operators expressed as Spark DataFrame plans."""
