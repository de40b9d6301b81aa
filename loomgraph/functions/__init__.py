"""Part of loomgraph."""
