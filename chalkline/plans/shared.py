"""Stage boundaries of whole-review plans."""

from chalkline.operators.stages import kept

__all__ = ["kept"]
