"""Image-relational analytics on Spark: an image is a relation of pixels with a metadata row.

A pixel relation has the columns image_id, y, x and v, and any others (grp, c, pixel_shift).
Operators take and return such relations; Catalyst plans them together.
"""
