"""Customer-360 analytics for insurance data, written as PySpark DataFrame operators.

Layers, bottom up:

* ``functions`` -- column helpers (text scoring, health scores, NULL rules)
* ``sources``   -- table schemas, readers, writers, the sample-table mapping, data generators
* ``operators`` -- enrichment, events, moments, health, actions, workflow, evidence search
* ``plans``     -- the batch pipeline, look-ups, portfolio queries, metrics, checks
* ``streaming`` -- Structured Streaming variants of the feeds
"""

__version__ = "0.1.0"
