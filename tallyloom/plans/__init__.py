"""Query plans over the supplied tables; importing ``catalogue`` registers them all."""
