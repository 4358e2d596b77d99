"""shipgraph — Spark-native analytics for shipment networks.

Every public operator is a function from DataFrame(s) to a DataFrame so that
Catalyst plans the whole chain; nothing is collected to the driver on the row
path.  Sub-packages:

* ``sources``   – table readers, the shipments view, parquet/json sinks
* ``functions`` – column-expression helpers (null-safe clip, ratios, bins …)
* ``operators`` – profiling, cleaning, corridor/facility aggregation, graph
                  algorithms, features, models, evaluation, scoring
* ``plans``     – the registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
