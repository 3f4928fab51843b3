"""Sequential geometry on one mesh, in NumPy. Spark calls these per mesh or part; see ``meshlake.operators.solids``.

A mesh is an (n, 3) float array of points and an (m, 3) int array of faces, wound outwards.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import md5

import numpy as np

Array = np.ndarray
NO_FACES = np.zeros((0, 3), dtype=np.int64)


@dataclass
class Solid:
    """A part on its way through splitting."""

    points: Array
    faces: Array
    is_new: Array | None = None  # null: all are from the start
    tokens: Array | None = None  # provenance of each face; 0 if none
    edges: Array = field(default_factory=lambda: np.zeros((0, 2), dtype=np.int64))
    hull: Array | None = None
    rank: float | None = None
    known: bool = False  # whether the edges of new points have been looked for

    def face_tokens(self) -> Array:
        return np.zeros(len(self.faces), dtype=np.int64) if self.tokens is None else self.tokens


def face_areas(points: Array, faces: Array) -> Array:
    a, b, c = points[faces[:, 0]], points[faces[:, 1]], points[faces[:, 2]]
    return 0.5 * np.linalg.norm(np.cross(b - a, c - a), axis=1)


def face_normals(points: Array, faces: Array) -> Array:
    """Unit normals; NaN for degenerate faces."""
    a, b, c = points[faces[:, 0]], points[faces[:, 1]], points[faces[:, 2]]
    n = np.cross(b - a, c - a)
    with np.errstate(invalid="ignore", divide="ignore"):
        return n / np.linalg.norm(n, axis=1, keepdims=True)


def volume(points: Array, faces: Array) -> float:
    if not len(faces):
        return 0.0
    a, b, c = points[faces[:, 0]], points[faces[:, 1]], points[faces[:, 2]]
    return float(np.einsum("ij,ij->i", a, np.cross(b, c)).sum() / 6)


def radius_of(v: float) -> float:
    return float((3 * abs(v) / (4 * 3.14159265)) ** (1 / 3))


def is_closed(faces: Array) -> bool:
    """Every directed side occurs once, and so does its reverse."""
    sides = np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]])
    seen = {(int(u), int(v)) for u, v in sides}
    return len(seen) == len(sides) and all((v, u) in seen for u, v in seen)


# --- convex hull -------------------------------------------------------------


def convex_hull(points: Array) -> Array:
    """Faces of the convex hull over the given points, wound outwards; none if the points are flat.

    Quickhull: each face keeps the points above it; the farthest of a face replaces all faces
    that it sees by a fan from their horizon.
    """
    p = np.asarray(points, dtype=float)
    if len(p) < 4:
        return NO_FACES
    scale = float(np.abs(p).max()) or 1.0
    eps = scale * 1e-12 * 8
    ends = np.concatenate([p.argmin(axis=0), p.argmax(axis=0)])
    gaps = np.linalg.norm(p[ends][:, None] - p[ends][None], axis=2)
    i, j = (int(ends[k]) for k in np.unravel_index(gaps.argmax(), gaps.shape))
    if np.linalg.norm(p[j] - p[i]) <= eps:
        return NO_FACES
    along = (p[j] - p[i]) / np.linalg.norm(p[j] - p[i])
    off = np.linalg.norm(np.cross(p - p[i], along), axis=1)
    k = int(off.argmax())
    if off[k] <= scale * 1e-10:
        return NO_FACES
    n = np.cross(p[j] - p[i], p[k] - p[i])
    n /= np.linalg.norm(n)
    high = (p - p[i]) @ n
    t = int(np.abs(high).argmax())
    if abs(high[t]) <= scale * 1e-10:
        return NO_FACES
    if high[t] > 0:
        i, j = j, i
    faces: dict[int, tuple[int, int, int]] = {}
    plane: dict[int, tuple[Array, float]] = {}
    above: dict[int, Array] = {}
    side: dict[tuple[int, int], int] = {}
    waiting: deque[int] = deque()
    count = 0

    def add(f: tuple[int, int, int], candidates: Array) -> Array:
        nonlocal count
        a, b, c = (p[x] for x in f)
        normal = np.cross(b - a, c - a)
        size = np.linalg.norm(normal)
        normal = normal / size if size > 0 else normal
        at = float(normal @ a)
        faces[count], plane[count] = f, (normal, at)
        for u, v in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
            side[u, v] = count
        over = p[candidates] @ normal - at > eps if len(candidates) else np.zeros(0, dtype=bool)
        above[count] = candidates[over]
        if over.any():
            waiting.append(count)
        count += 1
        return candidates[~over]

    left = np.setdiff1d(np.arange(len(p)), [i, j, k, t])
    for f in ((i, j, k), (i, t, j), (j, t, k), (k, t, i)):
        left = add(f, left)
    while waiting:
        at = waiting.popleft()
        if at not in faces or not len(above[at]):
            continue
        normal, d = plane[at]
        top = int(above[at][(p[above[at]] @ normal).argmax()])
        seen, stack, horizon = {at}, [at], []
        while stack:
            f = faces[stack.pop()]
            for u, v in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
                other = side[v, u]
                if other in seen:
                    continue
                normal, d = plane[other]
                if p[top] @ normal - d > eps:
                    seen.add(other)
                    stack.append(other)
                else:
                    horizon.append((u, v))
        horizon = [(u, v) for u, v in horizon if side[v, u] not in seen]
        left = np.unique(np.concatenate([above[s] for s in seen]))
        left = left[left != top]
        for s in seen:
            f = faces.pop(s)
            above.pop(s)
            for u, v in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
                if side.get((u, v)) == s:
                    del side[u, v]
        for u, v in horizon:
            left = add((u, v, top), left)
    return np.array(list(faces.values()), dtype=np.int64)


def fix_normals(points: Array, faces: Array) -> Array:
    """Faces wound so that normals point away from the mean of all points."""
    a, b, c = points[faces[:, 0]], points[faces[:, 1]], points[faces[:, 2]]
    inward = np.einsum("ij,ij->i", np.cross(b - a, c - a), points.mean(axis=0) - a) > 0
    out = faces.copy()
    out[inward] = out[inward][:, [0, 2, 1]]
    return out


# --- connectivity ------------------------------------------------------------


def face_labels(faces: Array) -> Array:
    """For each face the smallest face that sides lead to."""
    m = len(faces)
    label = np.arange(m)
    if not m:
        return label
    sides = np.sort(np.concatenate([faces[:, [0, 1]], faces[:, [1, 2]], faces[:, [2, 0]]]), axis=1)
    owner = np.tile(np.arange(m), 3)
    order = np.lexsort((owner, sides[:, 1], sides[:, 0]))
    sides, owner = sides[order], owner[order]
    same = (sides[1:] == sides[:-1]).all(axis=1)
    u, v = owner[:-1][same], owner[1:][same]
    while True:
        before = label.copy()
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        label = label[label]
        if (label == before).all():
            return label


def separate(part: Solid, least_volume: float = 1e-6) -> list[Solid]:
    """Connected components in order of their first face; those of next to no volume go.

    Points are numbered by their first corner. An edge goes to the first component that holds both ends.
    """
    label, out = face_labels(part.faces), []
    free = np.ones(len(part.edges), dtype=bool)
    for root in np.unique(label):
        rows = label == root
        corners = part.faces[rows].ravel()
        used, first = np.unique(corners, return_index=True)
        used = used[np.argsort(first)]
        renamed = np.full(len(part.points), -1)
        renamed[used] = np.arange(len(used))
        edges = renamed[part.edges] if len(part.edges) else part.edges
        own = free & (edges >= 0).all(axis=1) if len(edges) else free
        free = free & ~own
        faces = renamed[part.faces[rows]]
        if abs(volume(part.points[used], faces)) < least_volume:
            continue
        out.append(
            Solid(
                part.points[used], faces, None if part.is_new is None else part.is_new[used],
                None if part.tokens is None else part.tokens[rows], np.sort(edges[own], axis=1) if len(edges) else edges,
            )
        )
    return out


def flat_surfaces(points: Array, faces: Array, min_area: float = 0.1, most: int = 40) -> tuple[Array, list[Array], Array]:
    """Planes (a, b, c, d) just above the large flat regions of a mesh, the faces of each, and their areas.

    Regions grow face by face in order, by the running mean of normals; large ones are kept,
    the largest first if there are many; planes that repeat an earlier one go.
    """
    m = len(faces)
    normals, areas = face_normals(points, faces), face_areas(points, faces)
    near: list[list[int]] = [[] for _ in range(m)]
    by_side: dict[tuple[int, int], list[int]] = {}
    for f, (a, b, c) in enumerate(faces.tolist()):
        for u, v in ((a, b), (b, c), (c, a)):
            by_side.setdefault((min(u, v), max(u, v)), []).append(f)
    for own in by_side.values():
        for f in own:
            near[f] += [g for g in own if g != f]
    used, regions = np.zeros(m, dtype=bool), []
    for start in range(m):
        if used[start]:
            continue
        used[start] = True
        own, mean, pending = [start], normals[start], deque([start])
        while pending:
            for g in near[pending.popleft()]:
                if used[g]:
                    continue
                size = np.linalg.norm(mean) * np.linalg.norm(normals[g])
                if mean @ normals[g] > 0.999 * size:
                    used[g] = True
                    own.append(g)
                    mean = mean + (normals[g] - mean) / len(own)
                    pending.append(g)
        regions.append(np.array(own))
    sizes = np.array([areas[r].sum() for r in regions])
    kept = [k for k in range(len(regions)) if sizes[k] > min_area]
    if len(kept) > most:
        kept = sorted(kept, key=lambda k: (-sizes[k], k))[:most]
    planes: list[Array] = []
    chosen: list[int] = []
    for k in kept:
        n = normals[regions[k]].sum(axis=0)
        if not np.linalg.norm(n) > 0:
            continue
        n = n / np.linalg.norm(n)
        at = points[faces[regions[k]]].mean(axis=(0, 1)) + 0.02 * n
        plane = np.append(n, -n @ at)
        if all(abs(plane @ q) <= (1 - 1e-4) * np.linalg.norm(plane) * np.linalg.norm(q) for q in planes):
            planes.append(plane)
            chosen.append(k)
    return np.array(planes).reshape(-1, 4), [regions[k] for k in chosen], sizes[chosen]


# --- visibility --------------------------------------------------------------


def crosses(points: Array, pairs: Array, corners: Array, margin: float = 1e-3, chunk: int = 1 << 18) -> Array:
    """Which pairs' segments, less ``margin`` at both ends, cross one of the triangles ``corners`` (m, 3, 3).

    A line passes through a triangle if its Pluecker products with the three sides agree in
    sign, which is one matrix product for many lines and sides; the place along the segment
    is only computed for what is left.
    """
    out = np.zeros(len(pairs), dtype=bool)
    if not len(pairs) or not len(corners):
        return out
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    sides = [np.concatenate([np.cross(u, v), v - u], axis=1).T for u, v in ((a, b), (b, c), (c, a))]
    normal = np.cross(b - a, c - a)
    size = np.linalg.norm(normal, axis=1)
    good = size > 1e-14
    normal[good] /= size[good, None]
    offset = np.einsum("ij,ij->i", normal, a)
    # Which points lie above and below each triangle's plane; heights themselves are only needed where a line passes.
    above, below = (np.zeros((len(points), len(corners)), dtype=bool) for _ in range(2))
    step = max(1, chunk // len(corners))
    for at in range(0, len(points), step):
        height = points[at : at + step] @ normal.T - offset
        above[at : at + step], below[at : at + step] = height > -1e-9, height < 1e-9
    # First in single precision, with a margin for its errors; what passes is tested again.
    single = [x.astype(np.float32) for x in sides]
    reach = float(np.abs(points).max())
    slack = np.float32(1e-5 * max(float(np.abs(x).max()) for x in sides) * max(2 * reach, 2 * reach * reach))
    for at in range(0, len(pairs), step):
        i, j = pairs[at : at + step, 0], pairs[at : at + step, 1]
        p, q = points[i], points[j]
        line = np.concatenate([q - p, np.cross(p, q)], axis=1).astype(np.float32)
        w = line @ single[0]
        low, high = w.copy(), w
        for s in single[1:]:
            w = line @ s
            np.minimum(low, w, out=low)
            np.maximum(high, w, out=high)
        hit = (low >= -slack) | (high <= slack)
        hit &= good
        hit &= (above[i] & below[j]) | (below[i] & above[j])
        r, t = np.nonzero(hit)
        if len(r):
            out[at + np.unique(r[cross_each(p[r], q[r], corners[t], margin)])] = True
    return out


def cross_each(p: Array, q: Array, corners: Array, margin: float = 1e-3) -> Array:
    """Which segments p-q, less ``margin`` at both ends, cross the triangle of the same row; the same test as :func:`crosses`, row by row."""
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]
    normal = np.cross(b - a, c - a)
    size = np.linalg.norm(normal, axis=1)
    hit = size > 1e-14
    normal[hit] /= size[hit, None]
    h0, h1 = (((end - a) * normal).sum(axis=1) for end in (p, q))
    hit &= ((h0 > -1e-9) & (h1 < 1e-9)) | ((h0 < 1e-9) & (h1 > -1e-9))
    rows = np.flatnonzero(hit)
    p, q, a, b, c, h0, h1 = (x[rows] for x in (p, q, a, b, c, h0, h1))
    along, moment = q - p, np.cross(p, q)
    w = np.stack([(along * np.cross(u, v)).sum(axis=1) + (moment * (v - u)).sum(axis=1) for u, v in ((a, b), (b, c), (c, a))])
    length = np.linalg.norm(along, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        place = length * h0 / (h0 - h1)
    ok = ((w >= -1e-12).all(axis=0) | (w <= 1e-12).all(axis=0)) & (place > margin) & (place < length - margin)
    out = np.zeros(len(hit), dtype=bool)
    out[rows[ok]] = True
    return out


def _cross(u: list[Array], v: list[Array]) -> list[Array]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def segment_hits(p: Array, q: Array, corners: Array, margin: float = 1e-3) -> Array:
    """Which segments p-q, less ``margin`` at both ends, cross which triangle ``corners`` (..., 3, 3), in the steps of ``geometry.with_hits``; leading axes are broadcast."""
    p, w, a, b, c = (_axes(x) for x in (p, q - p, *(corners[..., k, :] for k in range(3))))
    length = np.sqrt(_dot(w, w))
    e, f = _minus(b, a), _minus(c, a)
    with np.errstate(all="ignore"):
        w = [x / length for x in w]
        s, h = _minus(p, a), _cross(w, f)
        det = _dot(e, h)
        u = _dot(s, h) / det
        hit = (np.abs(det) > 1e-12) & (u >= -1e-9) & (u <= 1 + 2e-9)
        m = _cross(s, e)
        v, t = _dot(w, m) / det, _dot(f, m) / det
        return hit & (v >= -1e-9) & (u + v <= 1 + 1e-9) & (t > margin) & (t < length - margin)


def seen_pairs(points: Array, own: Array, cage: Array, chunk: int = 1 << 17) -> tuple[Array, Array, Array]:
    """Of many meshes alike in size, points (n, v, 3) and corners (n, t, 3, 3) of the meshes and their cages: the mesh and both points of all pairs that cross a cage but not the mesh.

    Only a triangle whose plane parts the two points is tested.
    """
    i, j = np.triu_indices(points.shape[1], 1)
    seen = np.ones((len(points), len(i)), dtype=bool)
    for corners, wanted in ((cage, True), (own, False)):
        crossed = np.zeros_like(seen)
        wide = min(corners.shape[1], chunk)
        step = max(1, chunk // max(1, len(i) * wide))
        for at in range(0, len(points), step):
            p = points[at : at + step]
            for t in range(0, corners.shape[1], max(1, wide)):
                c = corners[at : at + step, t : t + wide]
                a = _axes(c[:, :, 0])
                normal = _cross(_minus(_axes(c[:, :, 1]), a), _minus(_axes(c[:, :, 2]), a))
                high = sum((p[:, :, None, k] - a[k][:, None]) * normal[k][:, None] for k in range(3))
                n, pair, tri = np.nonzero((high[:, i] * high[:, j] < 0) & seen[at : at + step, :, None])
                hit = segment_hits(p[n, i[pair]], p[n, j[pair]], c[n, tri])
                crossed[at + n[hit], pair[hit]] = True
        seen &= crossed == wanted
    mesh, pair = np.nonzero(seen)
    return mesh, i[pair], j[pair]


def visible_pairs(part: Solid, cage_points: Array, cage_faces: Array) -> Array:
    """Pairs (i < j) whose segment crosses the cage but not the part; only pairs with a new point if any are marked."""
    n = len(part.points)
    if part.is_new is None:
        i, j = np.triu_indices(n, 1)
    else:
        new = np.flatnonzero(part.is_new)
        old = np.flatnonzero(~part.is_new)
        a, b = np.triu_indices(len(new), 1)
        i = np.concatenate([new[a], np.repeat(new, len(old))])
        j = np.concatenate([new[b], np.tile(old, len(new))])
    pairs = np.sort(np.stack([i, j], axis=1), axis=1)
    pairs = pairs[crosses(part.points, pairs, cage_points[cage_faces])]
    return pairs[~crosses(part.points, pairs, part.points[part.faces])]


def edge_lengths(part: Solid) -> Array:
    return np.linalg.norm(part.points[part.edges[:, 0]] - part.points[part.edges[:, 1]], axis=1)


# --- planes ------------------------------------------------------------------


def candidate_planes(points: Array, edges: Array, rng: np.random.Generator, most: int = 2500) -> Array:
    """Planes that bisect edges drawn at random, at most ``most`` from five times as many draws.

    A plane is dropped if an earlier one has nearly the same direction (or its opposite) and
    the same offset, sign included.
    """
    if not len(edges):
        return np.zeros((0, 4))
    drawn = edges[rng.integers(0, len(edges), 5 * most)]
    p, q = points[drawn[:, 0]], points[drawn[:, 1]]
    size = np.linalg.norm(q - p, axis=1)
    _, first = np.unique(drawn, axis=0, return_index=True)
    keep = np.zeros(len(drawn), dtype=bool)
    keep[first] = True  # a repeated draw repeats its plane
    keep &= size >= 1e-6
    n = (q - p)[keep] / size[keep, None]
    d = -np.einsum("ij,ij->i", n, (p + q)[keep] / 2)
    near, out = np.cos(np.radians(5.0)), np.zeros((most, 4))
    count = 0
    for k in range(len(n)):
        if count == most:
            break
        if ((np.abs(out[:count, :3] @ n[k]) > near) & (np.abs(out[:count, 3] - d[k]) < 1e-3)).any():
            continue
        out[count, :3], out[count, 3] = n[k], d[k]
        count += 1
    return out[:count]


def plane_scores(planes: Array, points: Array, edges: Array, eps: float = 1e-6) -> Array:
    """Total length of the edges that each plane strictly separates."""
    length = np.linalg.norm(points[edges[:, 0]] - points[edges[:, 1]], axis=1)
    out = np.zeros(len(planes))
    step = max(1, (1 << 22) // max(1, len(edges)))
    for at in range(0, len(planes), step):
        value = planes[at : at + step, :3] @ points.T + planes[at : at + step, 3:]
        side = (value > eps).astype(np.int8) - (value < -eps).astype(np.int8)
        out[at : at + step] = (side[:, edges[:, 0]] * side[:, edges[:, 1]] < 0) @ length
    return out


# --- clipping ----------------------------------------------------------------


def weld(points: Array, eps: float = 1e-4) -> Array:
    """For each point the first earlier kept one within ``eps`` on every axis, else itself (greedy, in order)."""
    target, kept = np.arange(len(points)), []
    for k, p in enumerate(points):
        if kept:
            close = (np.abs(points[kept] - p) < eps).all(axis=1)
            if close.any():
                target[k] = kept[int(close.argmax())]
                continue
        kept.append(k)
    return target


def _loops(segments: list[tuple[int, int]]) -> list[list[int]]:
    """Closed walks through directed segments; open ends are left out."""
    ahead: dict[int, list[int]] = {}
    for u, v in segments:
        ahead.setdefault(u, []).append(v)
    out = []
    for start in list(ahead):
        while ahead.get(start):
            walk, place, at = [start], {start: 0}, start
            while ahead.get(at):
                at = ahead[at].pop()
                if at in place:
                    loop = walk[place[at] :]
                    if len(loop) > 2:
                        out.append(loop)
                    for x in loop[1:]:
                        place.pop(x, None)
                    walk = walk[: place[at] + 1]
                    if len(walk) == 1 and not ahead.get(at):
                        break
                else:
                    place[at] = len(walk)
                    walk.append(at)
    return out


def _turn(a: Array, b: Array, c: Array) -> float:
    return float((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]))


def _area2(xy: Array, loop: list[int]) -> float:
    p = xy[loop]
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - p[:, 1] * q[:, 0]).sum())


def _inside(point: Array, xy: Array, loop: list[int]) -> bool:
    p = xy[loop]
    q = np.roll(p, -1, axis=0)
    cut = (p[:, 1] > point[1]) != (q[:, 1] > point[1])
    with np.errstate(invalid="ignore", divide="ignore"):
        x = p[:, 0] + (point[1] - p[:, 1]) * (q[:, 0] - p[:, 0]) / (q[:, 1] - p[:, 1])
    return bool((cut & (point[0] < x)).sum() % 2)


def _bridged(xy: Array, outer: list[int], holes: list[list[int]]) -> list[int]:
    """One walk around a polygon and its holes, joined by bridges to the right."""
    for hole in sorted(holes, key=lambda h: -xy[h][:, 0].max()):
        k = int(xy[hole][:, 0].argmax())
        m, best, at = xy[hole[k]], np.inf, -1
        n = len(outer)
        for e in range(n):
            a, b = xy[outer[e]], xy[outer[(e + 1) % n]]
            if (a[1] > m[1]) == (b[1] > m[1]):
                continue
            x = a[0] + (m[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1])
            if m[0] - 1e-12 <= x < best:
                best, at = x, e if a[0] > b[0] else (e + 1) % n
        if at < 0:
            at = int(((xy[outer] - m) ** 2).sum(axis=1).argmin())
        else:
            # A corner inside the triangle to the hit may hide the chosen one: take the one nearest in angle.
            hit, tip = np.array([best, m[1]]), xy[outer[at]]
            hidden = []
            for e in range(n):
                v, w = xy[outer[e]], [m, hit, tip]
                s = [_turn(w[x], w[(x + 1) % 3], v) for x in range(3)]
                if e != at and v[0] > m[0] and (min(s) > 1e-12 or max(s) < -1e-12):
                    hidden.append((abs(v[1] - m[1]) / (v[0] - m[0]), e))
            if hidden:
                at = min(hidden)[1]
        outer = outer[: at + 1] + hole[k:] + hole[: k + 1] + outer[at:]
    return outer


def triangulate(xy: Array, loops: list[list[int]]) -> list[tuple[int, int, int]]:
    """Triangles of the region that loops bound, by ear clipping; loops within loops are holes by turns."""
    loops = [x for x in loops if abs(_area2(xy, x)) > 1e-18]
    depth = [sum(_inside(xy[a[0]], xy, b) for b in loops if b is not a) for a in loops]
    out: list[tuple[int, int, int]] = []
    for k, loop in enumerate(loops):
        if depth[k] % 2:
            continue
        outer = loop if _area2(xy, loop) > 0 else loop[::-1]
        holes = [b if _area2(xy, b) < 0 else b[::-1] for h, b in enumerate(loops) if depth[h] == depth[k] + 1 and _inside(xy[b[0]], xy, loop)]
        walk = _bridged(xy, outer, holes)
        while len(walk) > 3:
            n, ear, fallback = len(walk), -1, -1
            p = xy[walk]
            before, after = np.roll(p, 1, axis=0), np.roll(p, -1, axis=0)
            turn = (p[:, 0] - before[:, 0]) * (after[:, 1] - before[:, 1]) - (p[:, 1] - before[:, 1]) * (after[:, 0] - before[:, 0])
            for e in np.argsort(-turn, kind="stable"):
                if turn[e] <= 0:
                    break
                a, b, c = before[e], p[e], after[e]
                s = [(v[0] - u[0]) * (p[:, 1] - u[1]) - (v[1] - u[1]) * (p[:, 0] - u[0]) for u, v in ((a, b), (b, c), (c, a))]
                within = (s[0] >= 0) & (s[1] >= 0) & (s[2] >= 0)
                corner = (p == a).all(axis=1) | (p == b).all(axis=1) | (p == c).all(axis=1)
                fallback = int(e) if fallback < 0 else fallback
                if not (within & ~corner).any():
                    ear = int(e)
                    break
            if ear < 0:
                flat = np.flatnonzero(np.abs(turn) <= 1e-18)
                ear = int(flat[0]) if len(flat) else fallback
            if ear < 0:
                break
            out.append((walk[ear - 1], walk[ear], walk[(ear + 1) % n]))
            walk.pop(ear)
        if len(walk) == 3:
            out.append((walk[0], walk[1], walk[2]))
    return out


def clip(part: Solid, plane: Array, split: int = 0, eps: float = 1e-6) -> list[Solid]:
    """Both sides of a part, capped, positive first; the part alone if a side would have none of its points.

    Points of the cut are new in both. ``split`` numbers the cut: face k of the cap gets the
    token +-((split << 32) + k + 1), plus on the positive side. Edges go with their points.
    """
    p, n = part.points, len(part.points)
    value = p @ plane[:3] + plane[3]
    side = (value > eps).astype(int) - (value < -eps).astype(int)
    s = side[part.faces]
    flat = (s == 0).all(axis=1)
    if flat.any():
        normals = np.nan_to_num(face_normals(p, part.faces[flat]))
        s[flat] = np.where(((normals * plane[:3]) > 0).any(axis=1), -1, 1)[:, None]
    tokens = part.face_tokens()
    extra: list[Array] = []
    cut_at: dict[tuple[int, int], int] = {}

    def cut_point(u: int, v: int) -> int:
        u, v = min(u, v), max(u, v)
        if (u, v) not in cut_at:
            t = value[u] / (value[u] - value[v])
            cut_at[u, v] = n + len(extra)
            extra.append(p[u] + t * (p[v] - p[u]))
        return cut_at[u, v]

    kept: dict[int, tuple[list, list]] = {1: ([], []), -1: ([], [])}
    segments: list[tuple[int, int]] = []  # directed as the positive side's faces run along the cut
    for f, own, token in zip(part.faces.tolist(), s.tolist(), tokens.tolist(), strict=True):
        low, high = min(own), max(own)
        if low >= 0 or high <= 0:
            to = 1 if high > 0 else -1
            kept[to][0].append(f)
            kept[to][1].append(token)
            if own.count(0) == 2 and to == 1:
                k = own.index(1)
                segments.append((f[(k + 1) % 3], f[(k + 2) % 3]))
            continue
        walk: dict[int, list[int]] = {1: [], -1: []}
        for k in range(3):
            u, v, a, b = f[k], f[(k + 1) % 3], own[k], own[(k + 1) % 3]
            if a >= 0:
                walk[1].append(u)
            if a <= 0:
                walk[-1].append(u)
            if a * b < 0:
                c = cut_point(u, v)
                walk[1].append(c)
                walk[-1].append(c)
        for to, w in walk.items():
            for k in range(1, len(w) - 1):
                kept[to][0].append([w[0], w[k], w[k + 1]])
                kept[to][1].append(token)
        w = walk[1]
        on = [x >= n or side[x] == 0 for x in w]
        segments += [(w[k], w[(k + 1) % len(w)]) for k in range(len(w)) if on[k] and on[(k + 1) % len(w)]]
    if not (side > 0).any() or not (side < 0).any() or not kept[1][0] or not kept[-1][0]:
        return [part]
    points = np.concatenate([p, np.array(extra).reshape(-1, 3)])
    # Points of the cut that nearly coincide become one.
    border = sorted({x for seg in segments for x in seg})
    target = np.arange(len(points))
    if border:
        target[border] = np.array(border)[weld(points[border])]
    segments = [(int(target[u]), int(target[v])) for u, v in segments if target[u] != target[v]]
    # A segment and its reverse are a fold that needs no cap.
    seen = set(segments)
    segments = [(u, v) for u, v in dict.fromkeys(segments) if (v, u) not in seen]
    axis = np.eye(3)[int(np.abs(plane[:3]).argmin())]
    e1 = np.cross(plane[:3], axis)
    e1 /= np.linalg.norm(e1)
    e2 = np.cross(plane[:3], e1) / np.linalg.norm(plane[:3])
    xy = np.stack([points @ e1, points @ e2], axis=1)
    caps = triangulate(xy, _loops(segments))  # counter-clockwise seen from the positive side: normals along the plane's
    is_cut = np.zeros(len(points), dtype=bool)
    is_cut[border] = True
    out = []
    for to in (1, -1):
        faces = target[np.array(kept[to][0], dtype=np.int64).reshape(-1, 3)]
        whole = (faces[:, 0] != faces[:, 1]) & (faces[:, 1] != faces[:, 2]) & (faces[:, 2] != faces[:, 0])
        own = np.array(kept[to][1], dtype=np.int64)[whole]
        cap = np.array(caps, dtype=np.int64).reshape(-1, 3)
        cap = cap[:, [0, 2, 1]] if to == 1 else cap
        marks = to * ((split << 32) + np.arange(1, len(cap) + 1)) if split else np.zeros(len(cap), dtype=np.int64)
        faces, marks = np.concatenate([faces[whole], cap]), np.concatenate([own, marks])
        used = np.unique(faces)
        renamed = np.full(len(points), -1)
        renamed[used] = np.arange(len(used))
        edges = renamed[target[part.edges]] if len(part.edges) else part.edges
        edges = np.sort(edges[(edges >= 0).all(axis=1)], axis=1) if len(edges) else edges
        out.append(Solid(points[used], renamed[faces], is_cut[used], marks if split or part.tokens is not None else None, edges))
    return out


def multi_clip(part: Solid, planes: Array) -> list[Solid]:
    """Clip by one plane after the other; each cuts all that is there."""
    parts = [part]
    for k, plane in enumerate(planes, 1):
        parts = [x for own in parts for x in clip(own, plane, k)]
    return parts


def overlap_face(points1: Array, faces1: Array, points2: Array, eps: float = 1e-8) -> int:
    """The first face of one convex hull that has all of the other's points on its outer side, else -1."""
    n = face_normals(points1, faces1)
    d = np.einsum("ij,ij->i", n, points1[faces1[:, 0]])
    outer = (points2 @ n.T - d > -eps).all(axis=0)
    return int(outer.argmax()) if outer.any() else -1


# --- numbers by MD5 ----------------------------------------------------------

_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().tolist()
_SINES = [int(abs(np.sin(n + 1.0)) * 2**32) & 0xFFFFFFFF for n in range(64)]
_WORDS = [*range(16), *((5 * n + 1) % 16 for n in range(16)), *((3 * n + 5) % 16 for n in range(16)), *(7 * n % 16 for n in range(16))]


def _md5_starts(words: list[Array | None], n: int) -> Array:
    """The first 32 bits of the MD5 of ``n`` messages of one block each: sixteen arrays of words, None where all are zero."""
    a, b, c, d = (np.full(n, x, dtype=np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f, g = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint32)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif k < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif k < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f), np.add(f, np.uint32(_SINES[k]), out=f)
        if words[_WORDS[k]] is not None:
            np.add(f, words[_WORDS[k]], out=f)
        # The array that held a takes the sum: none is made anew.
        np.left_shift(f, np.uint32(_TURNS[k]), out=g), np.right_shift(f, np.uint32(32 - _TURNS[k]), out=f), np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (a + np.uint32(0x67452301)).byteswap()


@lru_cache(maxsize=16)
def _tails(at: int, first: int, count: int, ends: tuple[bytes, ...]) -> tuple[Array, list[bool]]:
    """Words of blocks whose text begins at ``at``: the numbers from ``first`` on, each with each of ``ends``, and what MD5 puts behind a text."""
    block = np.zeros((len(ends), count, 64), dtype=np.uint8)
    numbers = np.arange(first, first + count)
    width = np.searchsorted(10 ** np.arange(1, 19), numbers, side="right") + 1
    for n in np.unique(width).tolist():
        rows = width == n
        for place in range(n):
            block[:, rows, at + place] = 48 + numbers[rows] // 10 ** (n - 1 - place) % 10
        for k, end in enumerate(ends):
            block[k, rows, at + n : at + n + len(end) + 1] = np.frombuffer(end + b"\x80", dtype=np.uint8)
            block[k, rows, 56:58] = np.frombuffer((8 * (at + n + len(end))).to_bytes(2, "little"), dtype=np.uint8)
    words = np.ascontiguousarray(block.reshape(-1, 64).view("<u4").T)
    return words, words.any(axis=1).tolist()


def uniforms(prefix: bytes, first: int, count: int, ends: tuple[bytes, ...] = (b"",)) -> Array:
    """Numbers in [0, 1), a row for each of ``ends``: the first 32 bits of the MD5 of prefix, number and end, as ``graphs.uniform`` makes them."""
    if count < 64 or len(prefix) + 19 + max(map(len, ends)) > 55:
        starts = [[md5(prefix + str(n).encode() + end).digest()[:4] for n in range(first, first + count)] for end in ends]
        return np.array([[int.from_bytes(x) for x in row] for row in starts], dtype=float).reshape(len(ends), count) / 2**32
    words, any_bits = _tails(len(prefix), first, count, ends)
    head = np.frombuffer(prefix.ljust(64, b"\0"), dtype="<u4")
    own = [words[k] | head[k] if head[k] else (words[k] if any_bits[k] else None) for k in range(16)]
    return _md5_starts(own, len(ends) * count).reshape(len(ends), count) / 2**32


def drawn_samples(prefix: bytes, weight: Array, corners: Array, number: int, chunk: int = 1 << 13) -> Iterator[tuple[Array, Array, Array]]:
    """Points on triangles ``corners`` (n, 3, 3), in pieces: the number of each sample, its triangle's row, and the point.

    ``number`` of them by weight, each on the last triangle whose share of the running sum of weights begins at or before its number;
    then one on each triangle that got none.
    """
    upto = np.cumsum(weight)
    total = upto[-1] if len(upto) else 0.0
    rows = np.flatnonzero(weight > 0)
    low = (upto - weight)[rows]
    rows = rows[np.argsort(low, kind="stable")]
    low, got = np.sort(low), np.zeros(len(weight), dtype=bool)
    number = number if total > 0 else 0

    def placed(at: Array, u: Array, v: Array) -> Array:
        r, own = np.sqrt(u), corners[at]
        shares = (1 - r, r * (1 - v), r * v)
        return np.stack([shares[0] * own[:, 0, k] + shares[1] * own[:, 1, k] + shares[2] * own[:, 2, k] for k in range(3)], axis=1)

    for first in range(0, number, chunk):
        t, u, v = uniforms(prefix, first, min(chunk, number - first), (b":t", b":u", b":v"))
        at = rows[np.searchsorted(low, t * total, side="right") - 1]
        got[at] = True
        yield np.arange(first, first + len(at)), at, placed(at, u, v)
    at = np.flatnonzero(~got)
    if len(at):
        u, v = uniforms(prefix, number, len(at), (b":u", b":v"))
        yield np.arange(number, number + len(at)), at, placed(at, u, v)


# --- samples and distances ---------------------------------------------------


def sample_surface(points: Array, faces: Array, resolution: int, rng: np.random.Generator, base: float = 1.0, skip: Array | None = None) -> tuple[Array, Array]:
    """Points spread by area, with the face of each, and one more on each face that got none.

    Their number is the resolution times area / base, 1000 at least; with base 0, the resolution.
    ``skip`` marks faces that get no points by area.
    """
    if not len(faces):
        return np.zeros((0, 3)), np.zeros(0, dtype=np.int64)
    areas = face_areas(points, faces)
    n = max(1000, int(resolution * areas.sum() / base)) if base else resolution
    weight = areas if skip is None else np.where(skip, 0.0, areas)
    total = weight.sum()
    at = rng.choice(len(faces), n, p=weight / total) if total > 0 else np.zeros(0, dtype=np.int64)
    at = np.concatenate([at, np.flatnonzero(np.bincount(at, minlength=len(faces)) == 0)])
    root, b = np.sqrt(rng.random(len(at))), rng.random(len(at))
    shares, own = (1 - root, root * (1 - b), root * b), points[faces]
    out = np.empty((3, len(at)))
    for axis in range(3):
        p, q, r = (own[:, k, axis][at] for k in range(3))
        out[axis] = shares[0] * p + shares[1] * q + shares[2] * r
    return out.T, at


def _all_nearest(queries: Array, targets: Array, k: int) -> tuple[Array, Array]:
    """By brute force, in blocks of bounded size."""
    ids, far = np.zeros((len(queries), k), dtype=np.int64), np.zeros((len(queries), k))
    step = max(1, (1 << 20) // len(targets))
    for at in range(0, len(queries), step):
        d = np.linalg.norm(queries[at : at + step, None] - targets[None], axis=2)
        order = np.argsort(d, axis=1, kind="stable")[:, :k]
        ids[at : at + step], far[at : at + step] = order, np.take_along_axis(d, order, axis=1)
    return ids, far


#: The bits of the numbers up to 1,023, with two free places between them.
_SPREAD = sum((np.arange(1024) >> bit & 1) << (3 * bit) for bit in range(10))


def _along_curve(points: Array, low: Array, extent: float) -> Array:
    """An order that keeps near points together: bits of the three cell numbers interleaved."""
    out = sum(_SPREAD[((points[:, axis] - low[axis]) / extent * 1023).astype(np.int64)] << axis for axis in range(3))
    return np.argsort(out, kind="stable")


def _square(p: Array, q: Array) -> Array:
    """Squared distances along the last axis, axis by axis: NumPy's sums over a last axis of three are many times slower."""
    x, y, z = (p[..., a] - q[..., a] for a in range(3))
    return x * x + y * y + z * z


class Balls:
    """Targets in small balls along a curve, for searches of groups of near queries."""

    def __init__(self, targets: Array, low: Array, extent: float, block: int = 16):
        order = _along_curve(targets, low, extent)
        self.targets = targets
        self.order = np.concatenate([order, np.full(-len(order) % block, -1)]).reshape(-1, block)
        filled = self.order >= 0
        own = targets[np.where(filled, self.order, self.order[:, :1])]
        self.centre = own.mean(axis=1)
        self.radius = np.sqrt(_square(own, self.centre[:, None]).max(axis=1))
        self.first = own[:, 0]
        self.count = filled.sum(axis=1)

    def within(self, middles: Array, spreads: Array, chunk: int = 1 << 21) -> Array:
        """For each group of queries, a distance that none of them has to go farther than to its nearest target."""
        out, step = np.zeros(len(middles)), max(1, chunk // len(self.centre))
        size = (self.first**2).sum(axis=1)
        for at in range(0, len(middles), step):
            m = middles[at : at + step]
            square = (size - 2 * m @ self.first.T).min(axis=1) + (m**2).sum(axis=1)
            out[at : at + step] = np.sqrt(np.maximum(square, 0)) + 1e-7
        return out + spreads

    def some_near(self, q: Array, middle: Array, balls: int = 4) -> Array:
        """For each query of a group the distance to a near target, which may not be the nearest."""
        gap = ((self.centre - middle) ** 2).sum(axis=1)
        names = self.order[np.argpartition(gap, balls)[:balls] if len(gap) > balls else slice(None)].ravel()
        t = self.targets[names[names >= 0]]
        return np.sqrt(_square(q[:, None], t).min(axis=1)) + 1e-9

    def reached(self, q: Array, gap: Array, reach: float) -> tuple[Array, Array]:
        """Targets of balls nearer than ``reach`` to where ``gap`` is measured from, and squared distances of queries to them."""
        names = np.sort(self.order[gap - self.radius <= reach].ravel())
        names = names[names >= 0]
        return names, _square(q[:, None], self.targets[names])

    def candidates(self, q: Array, middle: Array, spread: float, k: int) -> tuple[Array, Array]:
        """Targets among which are the ``k`` nearest of each query of a group, and squared distances to them: only balls are opened that may hold one."""
        gap = np.sqrt(_square(self.centre, middle))
        return self.reached(q, gap, float((gap + self.radius)[self.count >= k].min()) + 2 * spread)

    def nearest(self, q: Array, middle: Array, spread: float, k: int) -> tuple[Array, Array]:
        """The ``k`` nearest targets of each query of a group."""
        return _chosen(*self.candidates(q, middle, spread, k), k)


def _chosen(names: Array, d: Array, k: int) -> tuple[Array, Array]:
    best = np.argpartition(d, k - 1, axis=1)[:, :k] if len(names) > k else np.tile(np.arange(k), (len(d), 1))
    high, mine = np.sqrt(np.take_along_axis(d, best, axis=1)), names[best]
    by = np.lexsort((mine, high), axis=1)
    return np.take_along_axis(mine, by, axis=1), np.take_along_axis(high, by, axis=1)


def _frame(queries: Array, targets: Array) -> tuple[Array, float]:
    low = np.minimum(queries.min(axis=0), targets.min(axis=0))
    return low, float((np.maximum(queries.max(axis=0), targets.max(axis=0)) - low).max()) or 1.0


def _groups(queries: Array, low: Array, extent: float, group: int = 16) -> tuple[list[Array], Array, Array]:
    """Rows of near queries together, the middle of each group and how far its queries are from that."""
    by_place = _along_curve(queries, low, extent)
    rows = [by_place[at : at + group] for at in range(0, len(queries), group)]
    at = np.arange(0, len(queries), group)
    own, count = queries[by_place], np.minimum(at + group, len(queries)) - at
    middles = np.add.reduceat(own, at) / count[:, None]
    return rows, middles, np.sqrt(np.maximum.reduceat(_square(own, np.repeat(middles, count, axis=0)), at))


def _alone(queries: Array, targets: Array, low: Array, extent: float, reach: float, most: int = 1 << 22) -> Array:
    """The rows of queries that share no cell with a target, of cells in which nothing is farther than ``reach`` apart."""
    side = reach / 3**0.5 * (1 - 1e-9)
    high = np.maximum(queries.max(axis=0), targets.max(axis=0))
    shape = np.floor((high - low) / side).astype(np.int64) + 1 if side > extent / most else np.array([most + 1])
    if float(np.prod(shape.astype(float))) > most:
        return np.arange(len(queries))

    def cell(p: Array) -> Array:
        x, y, z = (((p[:, a] - low[a]) / side).astype(np.int64) for a in range(3))
        return (x * shape[1] + y) * shape[2] + z

    taken = np.zeros(int(np.prod(shape)), dtype=bool)
    taken[cell(targets)] = True
    return np.flatnonzero(~taken[cell(queries)])


def nearest(queries: Array, targets: Array, k: int = 10, block: int = 16) -> tuple[Array, Array]:
    """Indices of and distances to the ``k`` nearest targets of each query, ties to the smaller index."""
    k = min(k, len(targets))
    if len(targets) <= 256 or k > block:
        return _all_nearest(queries, targets, k)
    low, extent = _frame(queries, targets)
    balls = Balls(targets, low, extent, block)
    ids, far = np.zeros((len(queries), k), dtype=np.int64), np.zeros((len(queries), k))
    for rows, middle, spread in zip(*_groups(queries, low, extent), strict=True):
        ids[rows], far[rows] = balls.nearest(queries[rows], middle, float(spread), k)
    return ids, far


def _axes(points: Array) -> list[Array]:
    """The three coordinates as arrays of their own: NumPy's sums over a last axis of three are many times slower."""
    return list(np.ascontiguousarray(np.moveaxis(np.asarray(points, dtype=float), -1, 0)))


def _minus(u: list[Array], v: list[Array]) -> list[Array]:
    return [x - y for x, y in zip(u, v, strict=True)]


def _dot(u: list[Array], v: list[Array]) -> Array:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def _to_segment(from_end: list[Array], along: list[Array], square: Array) -> Array:
    """``square``: that of ``from_end``, the way from the segment's second end."""
    size = np.sqrt(_dot(along, along))
    with np.errstate(invalid="ignore", divide="ignore"):
        reach = _dot(from_end, along) / size
    high = np.sqrt(np.maximum(0, square - reach * reach))
    return np.where((reach < 0) | (reach > size) | np.isnan(reach), np.inf, high)


def to_triangles(p: Array, a: Array, b: Array, c: Array) -> Array:
    """Distances from points to triangles, element by element."""
    p, a, b, c = (_axes(x) for x in (p, a, b, c))
    e, f, pa, pb, pc = _minus(c, a), _minus(b, a), _minus(p, a), _minus(p, b), _minus(p, c)
    with np.errstate(invalid="ignore", divide="ignore"):
        n = [f[1] * e[2] - f[2] * e[1], f[2] * e[0] - f[0] * e[2], f[0] * e[1] - f[1] * e[0]]
        size = np.sqrt(_dot(n, n))
        n = [x / size for x in n]
        off = _dot(n, pa)
        g = [x - off * y - z for x, y, z in zip(p, n, a, strict=True)]
        ee, ef, eg, ff, fg = _dot(e, e), _dot(e, f), _dot(e, g), _dot(f, f), _dot(f, g)
        det = ee * ff - ef * ef
        u, v = (ff * eg - ef * fg) / det, (ee * fg - ef * eg) / det
        inside = (u >= 0) & (v >= 0) & (u + v <= 1)
    squares = [_dot(x, x) for x in (pa, pb, pc)]
    ends = [(pb, _minus(a, b), squares[1]), (pc, _minus(b, c), squares[2]), (pa, _minus(c, a), squares[0])]
    around = np.minimum.reduce([*(_to_segment(*x) for x in ends), np.sqrt(np.minimum.reduce(squares))])
    return np.where(inside, np.abs(off), around)


def _to_faces_of(queries: Array, ids: Array, far: Array, target_faces: Array, points: Array, faces: Array) -> Array:
    """Distance of each query to the nearest of the triangles that its samples ``ids`` lie on; each triangle is measured once."""
    own = np.sort(target_faces[ids], axis=1)
    fresh = np.ones(own.shape, dtype=bool)
    fresh[:, 1:] = own[:, 1:] != own[:, :-1]
    r, c = np.nonzero(fresh)
    t = faces[own[r, c]]
    d = np.full(own.shape, np.inf)
    d[r, c] = to_triangles(queries[r], points[t[:, 0]], points[t[:, 1]], points[t[:, 2]])
    d = d.min(axis=1)
    return np.where(d > 10, far[:, 0], d)


def one_sided(queries: Array, targets: Array, target_faces: Array, points: Array, faces: Array, k: int = 10, block: int = 16, least: float = 0.0) -> float:
    """The largest distance from a query to the nearest of the triangles that its ``k`` nearest samples lie on.

    No query is farther from these than from its nearest sample. So groups of queries are taken by a bound on that,
    the largest first, until no group that is left can be farther than what has been found, or than ``least``:
    what isn't farther than that needn't be known.
    """
    if not len(queries) or not len(targets):
        return least
    k, best = min(k, len(targets)), least

    def measured(rows: Array, ids: Array, far: Array) -> float:
        d = _to_faces_of(queries[rows], ids, far, target_faces, points, faces)
        d = d[np.isfinite(d)]
        return float(d.max()) if len(d) else 0.0

    if len(targets) <= 256 or k > block:
        return max(best, measured(np.arange(len(queries)), *_all_nearest(queries, targets, k)))
    low, extent = _frame(queries, targets)
    balls = Balls(targets, low, extent, block)

    def around(rows: Array) -> tuple[Array, Array, float]:
        own = queries[rows]
        middle = own.mean(axis=0)
        return own, middle, float(np.sqrt(_square(own, middle).max())) + 1e-9

    def opened(rows: Array, middle: Array) -> None:
        """Queries of a group are dropped by the nearest targets of a few balls, by their nearest, by the triangle of that, which is one of those asked for."""
        nonlocal best
        near = balls.some_near(queries[rows], middle)
        rows, near = rows[near > best], near[near > best]
        if not len(rows):
            return
        own, middle, spread = around(rows)
        names, d = balls.reached(own, np.sqrt(_square(balls.centre, middle)), float(near.max()) + spread)
        first = d.argmin(axis=1)
        high = np.sqrt(d[np.arange(len(d)), first])
        left = np.flatnonzero(high + 1e-9 > best)
        t = faces[target_faces[names[first[left]]]]
        one = to_triangles(own[left], points[t[:, 0]], points[t[:, 1]], points[t[:, 2]])
        rows = rows[left[~(np.where(one > 10, high[left], one) <= best)]]
        if len(rows):
            best = max(best, measured(rows, *balls.nearest(*around(rows), k)))

    # A few queries first: with what they tell, most others needn't be looked at.
    few = np.linspace(0, len(queries) - 1, min(len(queries), 512)).astype(np.int64)
    far = balls.within(queries[few], np.zeros(len(few)))
    for n in np.argsort(-far, kind="stable")[:4].tolist():
        if far[n] > best:
            opened(few[n : n + 1], queries[few[n]])
    left = _alone(queries, targets, low, extent, best) if best > 0 else np.arange(len(queries))
    if not len(left):
        return best
    rows, middles, spreads = _groups(queries[left], low, extent)
    bound = balls.within(middles, spreads)
    for n in np.argsort(-bound, kind="stable").tolist():
        if bound[n] <= best:
            break
        opened(left[rows[n]], middles[n])
    return best


def hausdorff(points1: Array, faces1: Array, points2: Array, faces2: Array, resolution: int, rng: np.random.Generator) -> float:
    """Symmetric Hausdorff distance of two surfaces from samples; infinite if one has none."""
    s1, t1 = sample_surface(points1, faces1, resolution, rng)
    s2, t2 = sample_surface(points2, faces2, resolution, rng)
    if not len(s1) or not len(s2):
        return float("inf")
    return one_sided(s1, s2, t2, points2, faces2, least=one_sided(s2, s1, t1, points1, faces1))


def two_hull_samples(hull1: tuple[Array, Array], hull2: tuple[Array, Array], resolution: int, rng: np.random.Generator) -> tuple[Array, Array]:
    """Samples of two hulls by their share of the area, without the faces on the plane that parts them; faces of the second are numbered after the first's."""
    (p1, f1), (p2, f2) = hull1, hull2
    skip = [np.zeros(len(f1), dtype=bool), np.zeros(len(f2), dtype=bool)]
    at = overlap_face(p1, f1, p2)
    if at >= 0:
        n = face_normals(p1, f1[at : at + 1])[0]
        d = n @ p1[f1[at, 0]]
        skip = [(np.abs(p[f] @ n - d) < 1e-3).all(axis=1) for p, f in (hull1, hull2)]
    a1, a2 = face_areas(p1, f1).sum(), face_areas(p2, f2).sum()
    n1 = int(resolution * a1 / (a1 + a2))
    s1, t1 = sample_surface(p1, f1, n1, rng, 0, skip[0])
    s2, t2 = sample_surface(p2, f2, resolution - n1, rng, 0, skip[1])
    return np.concatenate([s1, s2]), np.concatenate([t1, t2 + len(f1)])


# --- level-set remeshing -----------------------------------------------------


#: Lattice points of a triangle's box from which it is measured by itself.
BOX = 1500


def _to_box(planes: list[Array], corner: Array) -> Array:
    """Distances of all points of a box of lattice planes to one triangle that has an area: heights over its plane and ways along its sides are sums of three terms, one for each axis."""

    def summed(terms: list[Array]) -> Array:
        return (terms[0][:, None] + terms[1])[:, :, None] + terms[2]

    off = [[x - w for x, w in zip(planes, p, strict=True)] for p in corner]

    def along(way: Array, n: int) -> Array:
        return summed([w * x for w, x in zip(way, off[n], strict=True)])

    e, f = corner[2] - corner[0], corner[1] - corner[0]
    normal = np.cross(f, e)
    normal /= np.sqrt(normal @ normal)
    ee, ef, ff = e @ e, e @ f, f @ f
    det = ee * ff - ef * ef
    u, v = along((ff * e - ef * f) / det, 0), along((ee * f - ef * e) / det, 0)
    inside = (u >= 0) & (v >= 0)
    inside &= np.add(u, v, out=u) <= 1
    least = None
    for n in range(3):
        way = corner[(n + 1) % 3] - corner[n]
        size = float(np.sqrt(way @ way))
        reach = along(way / size, n)
        t = np.clip(reach, 0, size)
        # Squared, to the point of the side that is t along it: the square to its end, less t (2 reach - t).
        reach *= 2
        reach -= t
        reach *= t
        square = np.subtract(summed([x * x for x in off[n]]), reach, out=reach)
        least = square if least is None else np.minimum(least, square, out=least)
    np.sqrt(np.maximum(least, 0, out=least), out=least)
    return np.where(inside, np.abs(along(normal, 0)), least)


def distance_grid(points: Array, faces: Array, band: float) -> tuple[Array, Array]:
    """Unsigned distance to the surface on the integer lattice, exact within ``band``, else infinite; and the lattice's origin."""
    low = np.floor(points.min(axis=0) - band - 2).astype(int)
    shape = np.ceil(points.max(axis=0) + band + 2).astype(int) - low + 1
    grid = np.full(shape, np.inf)
    flat, corners = grid.reshape(-1), points[faces]
    first = np.floor(corners.min(axis=1) - band).astype(np.int64)
    size = np.ceil(corners.max(axis=1) + band).astype(np.int64) - first + 1
    count = size.prod(axis=1)
    # Large triangles one by one, in slabs; what is left in batches.
    area = np.sqrt(_square(np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0]), np.zeros(3)))
    large = (count >= BOX) & (area > 1e-6)
    for n in np.flatnonzero(large).tolist():
        thick = max(1, 16_000 // int(size[n, 1] * size[n, 2]))
        y, z = (np.arange(first[n, k], first[n, k] + size[n, k]) for k in (1, 2))
        for at in range(0, int(size[n, 0]), thick):
            x = first[n, 0] + np.arange(at, min(at + thick, size[n, 0]))
            d = _to_box([x.astype(float), y.astype(float), z.astype(float)], corners[n])
            own = grid[tuple(slice(int(p[0] - low[k]), int(p[-1] - low[k]) + 1) for k, p in enumerate((x, y, z)))]
            np.copyto(own, d, where=(d <= band) & (d < own))
    corners, first, size, count = (v[~large] for v in (corners, first, size, count))
    ends, at = np.cumsum(count), 0
    while at < len(corners):  # faces whose boxes have about 16,000 lattice points together, which a core's cache holds
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + 16_000)))
        face = np.repeat(np.arange(at, to), count[at:to])
        local = np.arange(len(face)) - np.repeat(ends[at:to] - count[at:to] - (ends[at] - count[at]), count[at:to])
        box = size[face]
        place = np.stack([local // (box[:, 1] * box[:, 2]), local // box[:, 2] % box[:, 1], local % box[:, 2]], axis=1) + first[face]
        d = to_triangles(place.astype(float), corners[face, 0], corners[face, 1], corners[face, 2])
        near = d <= band
        np.minimum.at(flat, np.ravel_multi_index(tuple((place[near] - low).T), grid.shape), d[near])
        at = to
    return grid, low


def _square_to(p: list[Array], a: list[Array], b: list[Array], c: list[Array]) -> Array:
    """Squared distances from points to triangles, element by element, in the steps of ``geometry.with_closest``; all are lists of three axes."""

    ab, ac, pa, pb, pc = _minus(b, a), _minus(c, a), _minus(p, a), _minus(p, b), _minus(p, c)
    d1, d2, d3, d4, d5, d6 = _dot(ab, pa), _dot(ac, pa), _dot(ab, pb), _dot(ac, pb), _dot(ab, pc), _dot(ac, pc)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    with np.errstate(invalid="ignore", divide="ignore"):
        on_bc, total = (d4 - d3) / ((d4 - d3) + (d5 - d6)), va + vb + vc
        tests = [(d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (vc <= 0) & (d1 >= 0) & (d3 <= 0), (d6 >= 0) & (d5 <= d6), (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)]
        zero, one = np.zeros_like(d1), np.ones_like(d1)
        s = np.select(tests, [zero, one, d1 / (d1 - d3), zero, zero, 1 - on_bc], vb / total)
        t = np.select(tests, [zero, zero, zero, one, d2 / (d2 - d6), on_bc], vc / total)
    off = [x - (y + u * s + v * t) for x, y, u, v in zip(p, a, ab, ac, strict=True)]
    return _dot(off, off)


def near_lattice(corners: Array, chunk: int = 1 << 13) -> Iterator[tuple[Array, Array, Array]]:
    """Lattice points that triangles count for: in pieces, the number of the triangle, the point, and its squared distance.

    ``corners`` is (n, 9), in lattice units. A triangle seeds the points of its box within sqrt(0.75) of it, and the floor of its first corner; it
    counts for these and their 26 neighbours. Boxes, one point wider, are flattened one behind the other, cut in slabs where they
    are large, and seeds spread along one axis at a time: none lies on a border across, so none gets into the next box.
    """
    low, high = (f(corners.reshape(-1, 3, 3).min(axis=1) if f is np.floor else corners.reshape(-1, 3, 3).max(axis=1)).astype(np.int64) for f in (np.floor, np.ceil))
    wide = high - low + 3
    thick = np.maximum(1, chunk // (wide[:, 1] * wide[:, 2]))
    slabs = -(-wide[:, 0] // thick)
    tri = np.repeat(np.arange(len(corners)), slabs)
    nth = np.arange(len(tri)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    start = low[tri, 0] - 1 + nth * thick[tri]
    stop = np.minimum(start + thick[tri], high[tri, 0] + 2)  # what a slab gives; it holds a layer more on each side
    size = (stop - start + 2) * wide[tri, 1] * wide[tri, 2]
    ends, at, columns = np.cumsum(size), 0, np.ascontiguousarray(corners.T)
    while at < len(tri):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - size[at] + 2 * chunk)))
        unit = np.repeat(np.arange(at, to), size[at:to])
        own = tri[unit]
        local = np.arange(len(unit)) - (ends - size - (ends[at] - size[at]))[unit]
        along, across = wide[own, 2], wide[own, 1] * wide[own, 2]
        x, rest = local // across + start[unit] - 1, local % across
        y, z = rest // along + low[own, 1] - 1, rest % along + low[own, 2] - 1
        place = [x, y, z]
        a, b, c = ([columns[k + n][own] for n in range(3)] for k in (0, 3, 6))
        d2 = _square_to([v.astype(float) for v in place], a, c, b)
        first, inner = np.ones(len(own), dtype=bool), np.ones(len(own), dtype=bool)
        for n, v in enumerate(place):
            first &= v == np.floor(a[n])
            inner &= (v >= low[own, n]) & (v <= high[own, n])
        held = ((d2 <= 0.75) | first) & inner
        index = np.arange(len(own))
        for stride in (1, along, across):
            held = held | held[np.maximum(index - stride, 0)] | held[np.minimum(index + stride, len(own) - 1)]
        held &= (x >= start[unit]) & (x < stop[unit])
        yield own[held], np.stack([x[held], y[held], z[held]], axis=1), d2[held]
        at = to


def exterior(open_cells: Array) -> Array:
    """The open cells that a walk from the border of the grid reaches: sweeps along each axis until nothing changes. Axes before the last three number grids."""
    out = np.zeros_like(open_cells)
    for axis in (-3, -2, -1):
        side = np.moveaxis(out, axis, 0)
        side[0] = side[-1] = True
    out &= open_cells
    while True:
        before = int(out.sum())
        for axis in (-3, -2, -1):
            for flip in (False, True):
                o, m = np.moveaxis(out, axis, 0), np.moveaxis(open_cells, axis, 0)
                if flip:
                    o, m = o[::-1], m[::-1]
                for k in range(1, len(o)):
                    o[k] |= o[k - 1] & m[k]
        if int(out.sum()) == before:
            return out


def signed_grid(points: Array, faces: Array, iso: float) -> tuple[Array, Array]:
    """Distance to the closed surface at ``iso`` around a mesh, negative inside; large away from it. In lattice units."""
    grid, low = distance_grid(points, faces, iso + 1.05)
    outside = exterior(grid >= iso)
    phi = np.where(np.isfinite(grid), grid - iso, iso + 1.05)
    return np.where(outside, np.abs(phi), np.where(grid < iso, phi, -np.abs(phi))), low


def surface_nets(phi: Array, low: Array) -> tuple[Array, Array]:
    """The zero surface of a signed grid: a point in each mixed cell, a quad across each crossed lattice edge, cut in two triangles.

    Where a cell's surface isn't one sheet, its point is shared; such meshes are closed, but points may touch twice.
    """
    inside = phi < 0
    corner = [(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    n = np.array(phi.shape) - 1

    def at(offset: tuple[int, int, int], grid: Array) -> Array:
        return grid[tuple(slice(o, o + m) for o, m in zip(offset, n, strict=True))]

    count = sum(at(c, inside).astype(int) for c in corner)
    mixed = (count > 0) & (count < 8)
    number = np.full(mixed.shape, -1)
    number[mixed] = np.arange(int(mixed.sum()))
    cells = np.argwhere(mixed)
    total, seen = np.zeros((len(cells), 3)), np.zeros(len(cells))
    for a in corner:
        for axis in range(3):
            if a[axis]:
                continue
            b = tuple(v + (k == axis) for k, v in enumerate(a))
            u, v = at(a, phi)[mixed], at(b, phi)[mixed]
            cross = (u < 0) != (v < 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                t = np.where(cross, u / (u - v), 0.0)
            place = np.array(a, dtype=float)[None] + np.eye(3)[axis] * t[:, None]
            total += np.where(cross[:, None], place, 0.0)
            seen += cross
    points = cells + total / np.maximum(seen, 1)[:, None] + low
    quads = []
    for axis in range(3):
        u, v = (axis + 1) % 3, (axis + 2) % 3
        first = np.moveaxis(inside, axis, 0)
        change = np.moveaxis(first[:-1] != first[1:], 0, axis)
        edges = np.argwhere(change)
        edges = edges[(edges[:, u] > 0) & (edges[:, v] > 0) & (edges[:, u] < phi.shape[u] - 1) & (edges[:, v] < phi.shape[v] - 1)]
        ring = []
        for du, dv in ((-1, -1), (0, -1), (0, 0), (-1, 0)):
            cell = edges.copy()
            cell[:, u] += du
            cell[:, v] += dv
            ring.append(number[tuple(cell.T)])
        quad = np.stack(ring, axis=1)
        starts_inside = inside[tuple(edges.T)]
        quads.append(np.where(starts_inside[:, None], quad, quad[:, ::-1]))
    q = np.concatenate(quads)
    return points, np.concatenate([q[:, [0, 1, 2]], q[:, [0, 2, 3]]])


def remesh(points: Array, faces: Array, scale: float, iso: float) -> tuple[Array, Array]:
    """A closed surface ``iso`` away from a mesh, at ``scale`` lattice units per unit.

    The lattice is shifted by odd amounts, since faces that lie on it make ties.
    """
    shift = np.array([0.137, 0.271, 0.419])
    phi, low = signed_grid(points * scale + shift, faces, iso * scale)
    p, f = surface_nets(phi, low)
    return (p - shift) / scale, f
