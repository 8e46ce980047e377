"""DataFrame operators: encoding, k-NN joins, graphs, search, audits and metrics."""
