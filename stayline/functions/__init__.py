"""Column expressions and fixed values."""
from stayline.functions import constants, expr  # noqa: F401
