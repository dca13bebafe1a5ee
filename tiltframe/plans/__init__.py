"""The three end-to-end flows: extraction, sweep, model panel."""
