"""Where images and frames come from and go to."""
