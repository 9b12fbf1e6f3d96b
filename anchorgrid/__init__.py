"""Anchor-centred analytics on multimodal event tables, written as Spark jobs."""
