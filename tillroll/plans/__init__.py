"""The star-schema layer (``model``) and its materialisation (``warehouse``)."""
