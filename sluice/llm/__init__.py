"""Training-data operators: sharding, scans, joins, tokenizers, classifiers, dedup, packing, fingerprints."""
