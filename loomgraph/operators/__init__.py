"""DataFrame operators: sessions, search, fusion, graphs, summaries, quality, incremental work."""
