"""No streams: every source of this engine is a finite file or document.

Nothing here needs a watermark, a window or a state, so the package stays
empty on purpose.
"""
