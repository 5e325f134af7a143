"""Training-data pipeline operators (packing, mixing, quality, dedup, search, ...).

Nothing outside this package imports it. Every operator picks the columns it
needs by name (arguments) and returns columns of its own, so extra input
columns, whatever their names, neither reach it nor clash with its results.
"""
