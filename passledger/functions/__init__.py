from passledger.functions.scalars import *  # noqa: F401,F403
