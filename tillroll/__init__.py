"""tillroll: retail dashboard analytics as Spark DataFrame jobs.

Layers (each a plain DataFrame, lazily planned by Catalyst):

* ``sources``   – the four canonical inputs (order_items, products, users, events)
* ``plans``     – the star-schema layer (facts and dimensions) and its materialisation
* ``operators`` – the dashboard and analysis tables built on that layer
* ``functions`` – shared column expressions (safe division, exact rounding, policies)
* ``streaming`` – incremental form of the daily funnel
"""

from tillroll.plans.model import Model
from tillroll.registry import QUERIES, run_query

__all__ = ["Model", "QUERIES", "run_query"]
