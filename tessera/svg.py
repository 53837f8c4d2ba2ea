"""An image of partitions, drawn on the driver: as many shapes as there are partitions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

#: Pixels of the image for each unit of its width, and the default width in units.
SCALE, WIDTH = 8, 128


def draw(rings: DataFrame, colours: DataFrame, path: str, key: str = "partition_id", lines: DataFrame | None = None) -> None:
    """rings: (key, line, points). colours: (key, colour). lines: (line, points), drawn over them."""
    colour = {r[key]: r.colour for r in colours.collect()}
    shapes: dict[int, list] = {}
    for r in rings.select(key, "line", "points").orderBy(key, "line").collect():
        shapes.setdefault(r[key], []).append(r.points)
    over = [r.points for r in lines.select("points").collect()] if lines is not None else []
    points = [p for s in shapes.values() for ring in s for p in ring] + [p for t in over for p in t]
    if not points:
        Path(path).write_text('<svg xmlns="http://www.w3.org/2000/svg"/>\n')
        return
    west, east = min(p[0] for p in points), max(p[0] for p in points)
    south, north = min(p[1] for p in points), max(p[1] for p in points)
    unit = SCALE * WIDTH / max(east - west, north - south, 1e-12)
    at = lambda ring: " ".join(f"{(x - west) * unit:.2f},{(north - y) * unit:.2f}" for x, y in ring)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {(east - west) * unit:.2f} {(north - south) * unit:.2f}">']
    for k, own in shapes.items():
        out.append(f'<path fill-rule="evenodd" fill="{colour.get(k, "#cccccc")}" stroke="#000000" d="{" ".join("M " + at(ring) + " Z" for ring in own)}"/>')
    out += [f'<polyline fill="none" stroke="#000000" stroke-width="0.5" points="{at(t)}"/>' for t in over]
    Path(path).write_text("\n".join([*out, "</svg>"]) + "\n")
