"""packetlens sources"""
