"""Schemas of the engine's tables, as DDL. Ids and populations are longs, positions kilometres on a sphere, angles degrees."""

UNITS = "unit_id long, pop long, x double, y double, z double, var double"
#: geometry: polygons of rings of (x, y) points; a polygon's first ring is its exterior, and rings are closed.
BOUNDARIES = "unit_id long, geometry array<array<array<array<double>>>>"
EDGES = "src long, dst long, weight double"
ASSIGNMENT = "unit_id long, partition_id long"
STATES = "name string, alpha string, code long"
#: Raw returns are read by position: year, state, county code, party and votes are columns 1, 3, 5, 8 and 9.
RETURNS = "year int, state_name string, state_po string, county_name string, fips string, office string, candidate string, party string, votes long"

EARTH_RADIUS_KM = 6370.286
