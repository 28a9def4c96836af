"""From requests to plans: cells, relative time, drilldowns, mappings, stars and expressions."""
