from shoplens.functions.columns import *  # noqa: F401,F403
from shoplens.functions.text import *  # noqa: F401,F403
