"""Filters, projections, row ranges and ordered slices as DataFrame plans."""
