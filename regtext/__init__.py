"""regtext: registry and clinical-note analytics as Spark DataFrame operators.

Sub-packages:
  sources    - note / registry scans and result sinks
  functions  - column-expression builders (cleaning steps, fixed word lists, t quantiles)
  operators  - DataFrame -> DataFrame operators (prep, splits, sections, tokens, stats, metrics, models, pairs)
  plans      - the registered queries over the driver tables and their DuckDB oracle SQL
  streaming  - the same note operators attached to a Structured Streaming source
"""

__version__ = "0.1.0"
