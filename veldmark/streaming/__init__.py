"""Streams: upserts by key, running sets of detections, file sinks."""
