"""packetlens operators"""
