"""Sources: file listing (S1, S2), pictures and luminance grids (S3, H5), and the
driver's tables read as engine inputs."""
