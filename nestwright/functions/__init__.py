"""Column functions: cleaning, typing, identifiers, masking."""

from nestwright.functions.scalars import *  # noqa: F403
