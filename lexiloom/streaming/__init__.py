"""Operators over streams: mastery states, upserts of micro-batches."""
