"""themelens: weekly review themes, grounded quotes, metrics and reports as Spark DataFrame operators.

Every operator is ``DataFrame -> DataFrame`` (usable with ``df.transform``) or a ``Column -> Column``
function. Work is keyed by ``(product_id, iso_week)`` so one job covers every product and week.
"""

KEYS = ["product_id", "iso_week"]

__all__ = ["KEYS"]
