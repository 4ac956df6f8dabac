"""Streaming: intentionally empty.

The workload has no streams, watermarks, windows over event time or
stateful operators: every input is a finite file and every step is a batch
job.  Batch scoring of unlabelled rows (``operators.learners``) works on any
DataFrame, so a caller who receives records as a stream can apply it per
micro-batch with ``foreachBatch``; no stream-specific operator is needed.
"""
