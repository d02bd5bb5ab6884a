"""DataFrame-to-DataFrame operators: sampling, pairing, metrics, joins and splits."""
