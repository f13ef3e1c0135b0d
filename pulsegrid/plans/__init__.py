"""The step graph, its artifact store, and the imaging steps."""
