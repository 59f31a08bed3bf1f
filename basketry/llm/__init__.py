"""Training-data operators: extraction, search, tokenising, fingerprints,
packing, secret and license scans, near-duplicate joins, language and quality
models.  Nothing else in the library imports this subpackage."""
