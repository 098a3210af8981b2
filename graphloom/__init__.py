"""graphloom: DataFrame operators over evidence graphs, traces and text corpora."""
