"""Image codecs on numpy arrays; none of them needs Spark.

An image is a uint8 array of shape (height, width, 4) in the order r, g, b, a,
with straight alpha. Damage raises Malformed, features that are not covered
raise Unsupported, and sizes beyond the budget raise Refused.
"""


class Malformed(ValueError):
    """The bytes contradict their format."""


class Unsupported(Malformed):
    """A legal feature that this build does not decode."""


class Refused(Malformed):
    """The header claims more than the budget allows."""


#: Limits of a decoded image, in pixels (fixed values).
MAX_PIXELS, MIN_PIXELS, EXPANSION = 1 << 28, 1 << 20, 4096


def check_budget(width: int, height: int, length: int, bits: int = 8, frames: int = 1) -> None:
    if width < 1 or height < 1:
        raise Malformed(f"image size {width}x{height}")
    cap = min(MAX_PIXELS, max(MIN_PIXELS, length * (EXPANSION * 8 // min(max(bits, 1), 8))))
    if width * height > cap // max(frames, 1):
        raise Refused(f"{width}x{height} with {frames} frames is beyond the budget of {cap} pixels")
