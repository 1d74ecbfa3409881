"""genomespark: a PySpark-native engine for sequence, interval, feature and variant data.

The library declares DataFrame plans and leaves the physical work to Catalyst.  Sub-packages:

* ``functions``  column-to-column functions on sequences, k-mers and codons
* ``operators``  relational operators (intervals, hierarchies, skew, parsing, variants, ...)
* ``sources``    readers and writers for the usual text formats
* ``plans``      derived views and the registry of named queries with their SQL
* ``streaming``  Structured Streaming counterparts of the line readers
* ``llm``        training-data operators; nothing else imports it
"""

__version__ = "0.1.0"
