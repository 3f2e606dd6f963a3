"""Functions of columns: pixel values, colours, masks, wavelengths and times."""
