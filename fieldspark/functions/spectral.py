"""Reflectance scaling, quality bits and vegetation indices as native columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Band order, sensor asset maps, quality bits, index guards.
BAND_ORDER = ("BLUE", "GREEN", "RED", "NIR_NARROW", "SWIR1", "SWIR2")
L30_COLLECTION = "HLSL30_2.0"
S30_COLLECTION = "HLSS30_2.0"
L30_ASSETS = {"FMASK": "Fmask", "BLUE": "B02", "GREEN": "B03", "RED": "B04",
              "NIR_NARROW": "B05", "SWIR1": "B06", "SWIR2": "B07"}
S30_ASSETS = {"FMASK": "Fmask", "BLUE": "B02", "GREEN": "B03", "RED": "B04",
              "NIR_NARROW": "B8A", "SWIR1": "B11", "SWIR2": "B12"}
FILL_THRESHOLD = -9990.0
REFLECTANCE_SCALE = 0.0001
QA_FILL = 255
CLOUD, ADJACENT, SHADOW, SNOW, WATER = 1, 2, 3, 4, 5
INDICES = ("NDVI", "EVI", "GCVI", "NDWI")
DOUBLE_CROP_CODE = 26


def scale_reflectance(dn: Column, valid_range: tuple[float, float] | None = None,
                      scale: float = REFLECTANCE_SCALE) -> Column:
    """Digital number to reflectance; fill (and values outside the range) become NULL."""
    r = F.when(dn > F.lit(FILL_THRESHOLD), dn * F.lit(scale))
    if valid_range is None:
        return r
    lo, hi = valid_range
    return F.when((r >= F.lit(lo)) & (r <= F.lit(hi)), r)


def clear_mask(qa: Column, mask_adjacent: bool = True, mask_aerosol: bool = True,
               mask_water: bool = False) -> Column:
    """True where no masked quality bit is set. A missing QA byte counts as fill."""
    bits = [CLOUD, SHADOW, SNOW] + [ADJACENT] * mask_adjacent + [WATER] * mask_water
    q = F.coalesce(qa.cast("int"), F.lit(QA_FILL))
    clear = (q != QA_FILL) & (q.bitwiseAND(F.lit(sum(1 << b for b in bits))) == 0)
    if mask_aerosol:
        clear = clear & (F.shiftright(q, 6).bitwiseAND(F.lit(3)) != 3)
    return clear


def vegetation_indices(blue: Column, green: Column, red: Column, nir: Column, swir1: Column,
                       clear: Column, variant: str = "season") -> dict[str, Column]:
    """NDVI, EVI, GCVI and NDWI, NULL where a guard fails.

    ``season`` uses the guards of the county summaries (reflectance in 0..1.2, EVI
    denominator > 0.05, 0.02 < green < 1); ``monthly`` the wide guards of the
    exploratory monthly product.
    """
    if variant == "season":
        ok = clear
        for band in (nir, red, green, blue, swir1):
            ok = ok & band.isNotNull() & (band >= 0) & (band <= 1.2)
        evi_eps, green_ok = 0.05, (green > 0.02) & (green < 1.0)
    elif variant == "monthly":
        ok, evi_eps, green_ok = clear, 1e-6, green > 1e-6
    else:
        raise ValueError(f"unknown index variant {variant!r}")
    evi_den = nir + 6.0 * red - 7.5 * blue + 1.0
    return {
        "NDVI": F.when(ok & (F.abs(nir + red) > 1e-6), (nir - red) / (nir + red)),
        "EVI": F.when(ok & (F.abs(evi_den) > evi_eps), 2.5 * (nir - red) / evi_den),
        "GCVI": F.when(ok & green_ok, nir / green - 1.0),
        "NDWI": F.when(ok & (F.abs(nir + swir1) > 1e-6), (nir - swir1) / (nir + swir1)),
    }


def crop_mask(code: Column, mode: str = "binary", double_crop: bool = False) -> Column:
    """``binary`` (> 0), ``raw`` (soybean class, optionally double crop), ``fraction`` (> 0.5)."""
    if mode == "binary":
        hit = code > 0
    elif mode == "raw":
        hit = code.isin(5, DOUBLE_CROP_CODE) if double_crop else code == 5
    elif mode == "fraction":
        hit = code > 0.5
    else:
        raise ValueError("mode must be 'binary', 'raw' or 'fraction'")
    return F.coalesce(hit, F.lit(False))


def sensor_of(scene_id: Column, collection: Column) -> Column:
    """L30 or S30 from the collection or the scene id; anything else is an error."""
    s30 = (F.coalesce(collection, F.lit("")) == S30_COLLECTION) | F.contains(scene_id, F.lit("S30"))
    l30 = (F.coalesce(collection, F.lit("")) == L30_COLLECTION) | F.contains(scene_id, F.lit("L30"))
    return (F.when(s30, F.lit("S30")).when(l30, F.lit("L30"))
            .otherwise(F.raise_error(F.concat(F.lit("cannot identify sensor of "), scene_id))))


def file_name_of(url: Column, scene_id: Column, logical: Column) -> Column:
    """Last path part of an asset URL, else ``<scene>_<band>.tif``."""
    from .codes import safe_name
    name = F.url_decode(F.substring_index(F.regexp_replace(url, r"[?#].*$", ""), "/", -1))
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(
        F.concat(safe_name(scene_id), F.lit("_"), logical, F.lit(".tif")))


def canonical_bands(scene_id: Column, collection: Column, assets: Column,
                    l30: dict[str, str] | None = None, s30: dict[str, str] | None = None) -> Column:
    """Map canonical band -> (asset_key, url, filename); NULL when an asset is missing.

    ``assets`` is a MAP of sensor asset key to URL.
    """
    def literal(table: dict[str, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    wanted = F.when(sensor_of(scene_id, collection) == "S30", literal(s30 or S30_ASSETS)) \
        .otherwise(literal(l30 or L30_ASSETS))
    whole = F.forall(F.map_values(wanted), lambda key: F.array_contains(F.map_keys(assets), key))
    return F.when(whole, F.transform_values(wanted, lambda logical, key: F.struct(
        key.alias("asset_key"), F.try_element_at(assets, key).alias("url"),
        file_name_of(F.try_element_at(assets, key), scene_id, logical).alias("filename"))))
