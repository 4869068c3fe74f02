"""kontor: double-entry ledger and inventory analytics as Spark DataFrame / SQL jobs.

Subpackages: ``sources`` (data model, loaders, sinks, test-data mapping),
``functions`` (column expressions), ``operators`` (reports, posting,
inventory, FX, banking, receivables, hierarchies, audit), ``plans``
(registered queries with their SQL oracles) and ``streaming``.
"""

__version__ = "0.1.0"
