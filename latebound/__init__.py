"""latebound: marketplace delivery-delay analytics as Spark DataFrame operators.

From order lines, sellers, products and cities: late-delivery share of
revenue, seller-vs-carrier attribution, regional bottlenecks on cleansed
city names, RFM detection of high-revenue habitually late sellers, deciles
of seller-caused delay against product size, delay by tenure and retention
of first-month cohorts.
"""

__version__ = "0.1.0"
