"""DataFrame operators for supply-chain decisions under partial observability."""
