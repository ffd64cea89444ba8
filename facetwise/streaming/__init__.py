"""An extension: repositories fed by Structured Streaming."""
