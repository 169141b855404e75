"""Streaming.

The reference has no stream processing (no watermarks, event-time windows or state).  Its
only incremental behaviour is the append-only diagnosis / latency record log (S19), which
``records`` ingests as a Structured Streaming file stream.
"""
